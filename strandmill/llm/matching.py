"""Matching records that name a substance with the entities of another table, without a common key.

Candidates share a registry number or a name up to one edit; no pair outside is compared, and no group of pairs is
ever formed within one table. Each pair gets a vector of similarities (stem of the name, prefix of the name, two
registry numbers, partner gene), where what is missing stays missing. A mixture of two Gaussians, one for matches and
one for the rest, is fitted to all vectors without labels, until it no longer moves: covariance in blocks of related
similarities, regularised by the squared distance of the two means.

Two constraints of transitivity hold in every expectation step. The entities are known to be different from each other,
so a record can equal one of them at most: one unit of belief is shared among the candidates of a record and "none of
them". And records of one name form a class; if record r equals the rest of its class and they equal entity e, then r
equals e: belief(r, e) is at least belief(r, class) x belief(class, e), where the class stands for all triples (r, k, e)
with another record k, and k's beliefs come from the last step. Through its class a record also meets entities that it
shares no number or name with. The posterior of the last step is the confidence.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from strandmill.llm.lookalike import skeleton
from strandmill.operators.skew import HOT_SHARE, salted_join
from strandmill.session import forget, settle

# Prefixes of systematic names, their short forms, and spelled-out Greek letters.
SUBSTITUENTS = ("hydroxy", "methyl", "ethyl", "propyl", "butyl", "phenyl", "amino", "acetyl", "acetoxy", "methoxy", "oxo", "nitro", "chloro", "bromo", "fluoro")
PARTICLES = ("iso", "deoxy", "oxo", "nor", "homo", "epi", "dihydro", "dehydro", "cis-", "trans-")
SHORT = {"me": "methyl", "et": "ethyl", "oh": "hydroxy", "ac": "acetyl", "pr": "propyl", "bu": "butyl", "ph": "phenyl", "nh2": "amino", "ome": "methoxy"}
GREEK = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "omega": "ω"}
SALTS = ("sodium", "disodium", "potassium", "dipotassium", "calcium", "magnesium", "ammonium", "lithium", "zinc", "hydrochloride", "salt")
_BY_LENGTH = sorted(SUBSTITUENTS, key=len, reverse=True)
_PARTICLES = sorted(PARTICLES, key=len, reverse=True)
FEATURES = ("stem", "prefix", "registry_a", "registry_b", "partner")
#: Blocks of the covariance; similarities of different blocks are taken as independent.
BLOCKS = ((0, 1), (2,), (3,), (4,))
#: Similarities are compared in steps of 1 / STEPS, beliefs of a class in steps of 1 / LEVELS, so that equal evidence is counted once.
STEPS, LEVELS = 20, 10
#: None: a name or number leads to every entity that has it, however many those are. A number here is a rule of the
#: caller's: what more entities have identifies none by itself and counts together with a partner only.
CROWD: int | None = None
MOST_ROUNDS = 500


def _edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours as one edit."""
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        prev2, prev = prev, row
    return prev[-1]


def plain_name(name: str | None) -> str:
    """A name in systematic form: looks folded, lower case, no remarks, salt or plural, acids as their anion, prefix in front; '' for no name or a mere code."""
    s = re.sub(r"\s+", " ", (skeleton(name) or "").lower()).strip()
    s = re.sub(r"(\s*[(\[{][^)\]}]*[)\]}])+$", "", s)
    if m := re.match(r"(.+?)\s*,\s*(\S*(?:\s\S*)?-)$", s):
        s = (m[2][:-1] if m[2][0].isdigit() else m[2]) + m[1]
    s = re.sub(r"\s*,\s.*$", "", s)
    words = s.split(" ")
    while len(words) > 1 and words[-1] != "acid" and any(_edits(words[-1], w) <= (1 if len(w) > 4 else 0) for w in SALTS):
        words.pop()
    if len(words) > 1 and words[-1] == "acid" or len(words) > 1 and len(words[-1]) >= 3 and _edits(words[-1].removesuffix("s") if len(words[-1]) > 4 else words[-1], "acid") <= 1:
        words.pop()
        words[-1] = re.sub(r"[io]?[ci]c?$", "ate", words[-1]) if not words[-1].endswith("ic") else words[-1][:-2] + "ate"
    s = " ".join(words)
    s = re.sub(rf"^({'|'.join(GREEK)})[\s-]*", lambda m: GREEK[m[1]] + "-", s)
    s = re.sub(r"^([0-9]+|[dlrsn]|[α-ω])[\s-]+", r"\1-", s)
    s = re.sub(rf"^([0-9]+|n)-({'|'.join(SHORT)})[\s-]+", lambda m: f"{m[1]}-{SHORT[m[2]]}" + ("-" if m[1] == "n" else ""), s)
    s = re.sub(rf"^n-({'|'.join(SUBSTITUENTS)})[\s-]*", r"n-\1-", s)
    if len(s) > 6 and s.endswith("s") and not s.endswith("ss"):
        s = s[:-1]
    return s if re.search(r"[^\W\d_]{4}", s) else ""


def split_name(s: str) -> tuple[str, str]:
    """(prefix, stem) of a plain name. A number must be followed by a substituent, which may have one typing error."""
    if m := re.match(r"([0-9]+)-(.+)$", s):
        if exact := next((x for x in _BY_LENGTH if m[2].startswith(x) and len(m[2]) > len(x) + 2), None):
            return f"{m[1]}-{exact}", m[2][len(exact) :].lstrip("-")
        best = None
        for sub in SUBSTITUENTS:
            for n in range(len(sub) - 1, len(sub) + 2):
                head = m[2][:n]
                if len(m[2]) > n + 2 and (d := _edits(head, sub)) <= 1:
                    # of equal errors the one that keeps the first letter, then the one that ends alike
                    rank = (d, head[:1] != sub[:1], head[-1:] != sub[-1:], abs(n - len(sub)))
                    if best is None or rank < best[0]:
                        best = (rank, f"{m[1]}-{sub}", m[2][n:].lstrip("-"))
        return (best[1], best[2]) if best else (m[1] + "-", m[2])
    if m := re.match(r"n-([a-z]{3,})-(.+)$", s):
        group = m[1] if m[1] in SUBSTITUENTS else min(SUBSTITUENTS, key=lambda w: (_edits(m[1], w), m[1][0] != w[0]))
        return f"n-{group if _edits(m[1], group) <= 1 else m[1]}-", m[2]
    if m := re.match(r"([dlrsn]-|[α-ω]-)(.+)$", s):
        return m[1], m[2]
    for p in _PARTICLES:
        if s.startswith(p) and len(s) > len(p) + 3:
            return p, s[len(p) :]
    return "", s


def near_keys(s: str) -> list[str]:
    """The text and all texts with one character left out: two texts one edit (or swap) apart share one of them."""
    return sorted({s} | {s[:i] + s[i + 1 :] for i in range(len(s))}) if s else []


_NAME = StructType([StructField("plain", StringType()), StructField("prefix", StringType()), StructField("stem", StringType())])


@pandas_udf(_NAME)
def name_parts(names: pd.Series) -> pd.DataFrame:
    plain = names.map(plain_name)
    parts = plain.map(split_name)
    return pd.DataFrame({"plain": plain, "prefix": [p for p, _ in parts], "stem": [t for _, t in parts]})


@pandas_udf(ArrayType(StringType()))
def near_keys_of(names: pd.Series) -> pd.Series:
    return names.map(near_keys)


@dataclass
class Mixture:
    """Two Gaussians over the similarities: means and block covariances of matches (1) and the rest (0), and the share of matches."""

    share: float = 0.1
    mean: np.ndarray = field(default_factory=lambda: np.zeros((2, len(FEATURES))))
    cov: list[list[np.ndarray]] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of a match for each row of similarities; NaN is missing and tells nothing."""
        out = np.full(len(x), math.log(self.share / (1 - self.share)))
        for b, block in enumerate(BLOCKS):
            v = x[:, block]
            known = ~np.isnan(v).any(axis=1)
            if known.any():
                out[known] += _log_density(v[known], self.mean[1, block], self.cov[1][b]) - _log_density(v[known], self.mean[0, block], self.cov[0][b])
        return out


def _log_density(v: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = v - mean
    return -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1])


def _share_out(odds: np.ndarray, group: np.ndarray, times: np.ndarray | float = 1.0, bound: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each candidate when at most one of its group is a match; ``times`` candidates of a group are alike.

    ``bound`` is what transitivity demands at least; where it is more than the evidence gives, the rest of the group
    (and "none") shares what is left.
    """
    n = group.max() + 1
    top = np.zeros(n)
    np.maximum.at(top, group, odds)
    e = np.exp(odds - top[group])
    post = e / (np.exp(-top) + np.bincount(group, e * times, n))[group]
    if bound is None or not (bound > post).any():
        return post
    raised = bound > post
    asked = np.bincount(group, np.where(raised, bound * times, 0), n)
    left = 1 - np.bincount(group, np.where(raised, post * times, 0), n)
    return np.where(raised, bound / np.maximum(asked, 1)[group], post * (np.maximum(1 - asked, 0) / np.maximum(left, 1e-12))[group])


def _width() -> int:
    """Length of the sums of one component: weight, per block its weight, sums and products."""
    return 1 + sum(1 + len(b) + len(b) ** 2 for b in BLOCKS)


def _sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = [w.sum()]
    for block in BLOCKS:
        v = x[:, block]
        known = ~np.isnan(v).any(axis=1)
        v, u = v[known], w[known]
        out += [u.sum(), *(u @ v), *np.einsum("i,ij,ik->jk", u, v, v).ravel()]
    return np.array(out)


def _estimate(total: np.ndarray, before: Mixture | None) -> Mixture:
    """The mixture from the sums of both components; the covariance gains a share of the squared distance of the means."""
    half = _width()
    new = Mixture(share=min(max(total[half] / max(total[0] + total[half], 1e-9), 1e-6), 1 - 1e-6))
    raw: list[list[np.ndarray]] = [[], []]
    for k in (0, 1):
        at = k * half + 1
        for block in BLOCKS:
            n = len(block)
            w, s, p = total[at], total[at + 1 : at + 1 + n], total[at + 1 + n : at + 1 + n + n * n].reshape(n, n)
            at += 1 + n + n * n
            mean = (s + 0.5) / (w + 1)  # as if one pair of middling similarity had been seen
            new.mean[k, block] = mean
            raw[k].append(p / (w + 1e-9) - np.outer(s, s) / (w + 1e-9) ** 2 if w > 1e-6 else np.zeros((n, n)))
    for k in (0, 1):
        new.cov.append([])
        for b, block in enumerate(BLOCKS):
            gap = (new.mean[1, block] - new.mean[0, block]) ** 2
            new.cov[k].append(raw[k][b] + np.diag(0.1 * gap + 0.01))
    return new


def vector(key: str) -> list[float]:
    """The similarities of a pattern like ``20,20,-,0,20``."""
    return [math.nan if v == "-" else int(v) / STEPS for v in key.split(",")]


class NotConverged(RuntimeError):
    """The mixture still moved after the last round."""


def fit(patterns: DataFrame, start: Mixture | None = None, most: int = MOST_ROUNDS) -> Mixture:
    """Expectation-maximisation over ``patterns(vectors ARRAY<STRUCT<key, bound, times>>, n LONG)``: the different evidence of a record, and how many records have it.

    Every round is one job whose sums are added up by Spark; a row for each sum comes back. The first round takes pairs
    as matches whose known similarities average above a half and are the best of their record. Ends when the means and
    the share of matches stay as they are; raises ``NotConverged`` if they don't.
    """
    half = _width()
    model = start
    for _ in range(most):
        now = model

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(2 * half)
            seen: dict[str, list[float]] = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                sizes = pdf["vectors"].map(len).to_numpy()
                each = [v for vectors in pdf["vectors"] for v in vectors]
                x = np.array([seen.get(v["key"]) or seen.setdefault(v["key"], vector(v["key"])) for v in each])
                times = np.array([v["times"] for v in each], dtype=float)
                bound = np.array([v["bound"] for v in each], dtype=float) / LEVELS
                group = np.repeat(np.arange(len(sizes)), sizes)
                n = np.repeat(pdf["n"].to_numpy(), sizes).astype(float) * times
                if now is None:
                    known = ~np.isnan(x)
                    odds = 20 * (np.where(known, x, 0).sum(1) / np.maximum(known.sum(1), 1) - 0.6)
                else:
                    odds = np.clip(now.log_odds(x), -500, 500)
                post = _share_out(odds, group, times, bound)
                total[:half] += _sums(x, n * (1 - post))
                total[half:] += _sums(x, n * post)
            yield pd.DataFrame({"i": np.arange(2 * half), "v": total})

        total = np.zeros(2 * half)
        for r in patterns.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            total[r.i] = r.v
        new = _estimate(total, model)
        if model is not None and np.allclose(new.mean, model.mean, atol=1e-4) and abs(new.share - model.share) < 1e-5:
            return new
        model = new
    raise NotConverged(f"the mixture still moves after {most} rounds")


@dataclass(frozen=True)
class Columns:
    """Names of the attributes in a table: the key, the name, two registry numbers (their last run of digits counts), partner id and symbol."""

    key: str
    name: str
    registry_a: str
    registry_b: str
    partner_id: str
    partner_symbol: str


def _numbers(c: str) -> Column:
    return F.regexp_extract_all(F.col(f"`{c}`").cast("string"), F.lit(r"([0-9]{2,})"), F.lit(1))


def _partner_keys(c: Columns) -> Column:
    ident = F.regexp_extract(F.col(f"`{c.partner_id}`").cast("string"), r"([0-9]+)\s*$", 1)
    symbol = F.upper(F.trim(F.col(f"`{c.partner_symbol}`").cast("string")))
    return F.filter(F.array(F.when(ident != "", F.concat(F.lit("i"), ident)), F.when(symbol != "", F.concat(F.lit("s"), symbol))), lambda x: x.isNotNull())


def _entity_facts(entities: DataFrame, c: Columns) -> DataFrame:
    """``entity, kind, value, n``: the names, numbers and partners of each entity, and how many rows have them."""

    def some(kind: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    facts = F.concat(some("name", F.array(F.col(f"`{c.name}`").cast("string"))), some("a", _numbers(c.registry_a)), some("b", _numbers(c.registry_b)), some("partner", _partner_keys(c)))
    rows = entities.select(F.col(f"`{c.key}`").cast("string").alias("entity"), F.explode(facts).alias("f")).where("entity is not null and f.value is not null")
    return rows.groupBy("entity", "f.kind", "f.value").agg(F.count(F.lit(1)).alias("n"))


def _alike(plain: Column, prefix: Column, stem: Column, e_plain: Column, e_prefix: Column, e_stem: Column) -> Column:
    """``struct(sum, stem, prefix)``: how alike two names are in their stems and prefixes."""
    whole = F.levenshtein(plain, e_plain)
    stems = 1 - F.levenshtein(stem, e_stem) / F.greatest(F.length(stem), F.length(e_stem), F.lit(1))
    same = prefix == e_prefix
    # a prefix spoilt by a typing error reads as part of the stem
    spoilt = (prefix == "") & (F.length(e_prefix) > 2) & (whole <= 2) & ~e_prefix.rlike("^[0-9]")
    s = F.when(same, stems).when(spoilt, 1 - whole / F.length(plain)).otherwise(stems)
    p = F.when(same | spoilt, 1.0).otherwise(0.0)
    return F.when(plain.isNotNull() & e_plain.isNotNull(), F.struct((s + p).alias("sum"), s.alias("stem"), p.alias("prefix")))


def _alone() -> Column:
    """Whether a name or number leads to its entities by itself."""
    return F.lit(True) if CROWD is None else F.col("holders") <= CROWD


class _Evidence:
    """The tables from which candidates and their similarities are made; each is written once."""

    def __init__(self, rows: DataFrame, entities: DataFrame, ec: Columns):
        base = rows.groupBy("profile", "name", "a", "b", "partners").agg(F.count(F.lit(1)).alias("n"))
        names = settle(_named(rows.select("name").where("name is not null").distinct()), "names")
        self.profiles = settle(salted_join(base, names, "name", "left", F.col("profile")).drop("name"), "profiles")
        self.facts = settle(_entity_facts(entities, ec), "facts")
        spelled = _named(self.facts.where("kind = 'name'").select("entity", F.col("value").alias("name"), "n"))
        self.spelled = settle(spelled.groupBy("entity", F.col("plain").alias("e_plain"), F.col("prefix").alias("e_prefix"), F.col("stem").alias("e_stem")).agg(F.sum("n").alias("n")), "spelled")
        held = self.profiles.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("profiles")).first()
        self.rows, self.hot = held["all"] or 0, [r.plain for r in self.profiles.where("plain is not null").groupBy("plain").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= max(2, HOT_SHARE * held["profiles"])).collect()]  # 1 / HOT_SHARE names at most
        self.plains = names.select("plain", "prefix", "stem").distinct()
        usual = self.spelled.groupBy("entity").agg(F.max_by(F.struct("e_plain", "e_prefix", "e_stem"), F.struct("n", "e_plain")).alias("u"))
        crowd = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("holders"))
        numbers = self.facts.where("kind in ('a', 'b')").select("entity", "kind", F.concat_ws("|", "kind", "value").alias("key"))
        self.numbers = settle(numbers.join(crowd(numbers, "key"), "key"), "numbers")
        self.holders = settle(self.spelled.select("e_plain", "entity").join(crowd(self.spelled, "e_plain"), "e_plain"), "holders")
        has = lambda k: F.max(((F.col("kind") == k) & _alone()).cast("int")).alias(f"has_{k}")
        known = self.numbers.groupBy("entity").agg(has("a"), has("b"))
        self.entities = settle(usual.join(known, "entity", "full").select("entity", "u", F.coalesce("has_a", F.lit(0)).alias("has_a"), F.coalesce("has_b", F.lit(0)).alias("has_b")), "entities")
        self.partners = self.facts.where("kind = 'partner'").select(F.concat_ws("|", "entity", "value").alias("pair"), "entity", F.col("value").alias("partner"))

    def _beside_partner(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs by a crowded key: ``left(profile, key, partners, …)`` and ``right(key, entity)`` that share a partner as well."""
        both = right.join(self.partners.select("entity", "partner"), "entity").select(F.concat_ws("|", "key", "partner").alias("kp"), "entity").distinct()
        each = left.withColumn("partner", F.explode("partners")).withColumn("kp", F.concat_ws("|", "key", "partner")).drop("partners", "partner", "key")
        return salted_join(each, both, "kp", "inner", F.col("profile")).drop("kp")

    def candidates(self) -> DataFrame:
        """``profile, entity, near, hit_a, hit_b``: pairs that share a number, or a name up to one edit; ``near`` is how alike the names are that led to the pair."""
        lk = self.plains.select("plain", F.explode(near_keys_of("plain")).alias("near"))
        rk = self.spelled.select("e_plain").distinct().select("e_plain", F.explode(near_keys_of("e_plain")).alias("near"))
        near = lk.join(rk.hint("merge"), "near").select("plain", "e_plain").distinct()
        forms = self.spelled.select("e_plain", "e_prefix", "e_stem").distinct()
        scored = near.join(self.plains, "plain").join(forms, "e_plain")
        scored = settle(scored.select("plain", "e_plain", _alike(*map(F.col, ("plain", "prefix", "stem", "e_plain", "e_prefix", "e_stem"))).alias("near")), "near")
        alone = _alone()
        named = scored.join(self.holders.where(alone), "e_plain").groupBy("plain", "entity").agg(F.max("near").alias("near"))
        none = F.lit(0)
        out = salted_join(self.profiles.select("profile", "plain").where("plain is not null"), named, "plain", "inner", F.col("profile"), hot=self.hot).select("profile", "entity", "near", none.alias("hit_a"), none.alias("hit_b"))
        keys = F.concat(F.transform("a", lambda v: F.concat(F.lit("a|"), v)), F.transform("b", lambda v: F.concat(F.lit("b|"), v)))
        mine = self.profiles.select("profile", "partners", F.explode(keys).alias("key"))
        hit = lambda k: F.col("kind").eqNullSafe(k).cast("int").alias(f"hit_{k}")
        no_name = F.lit(None).cast("struct<sum:double,stem:double,prefix:double>").alias("near")
        by_number = salted_join(mine.select("profile", "key"), self.numbers.where(alone).select("key", "entity", "kind"), "key", "inner", F.col("profile"))
        out = out.unionByName(by_number.select("profile", "entity", no_name, hit("a"), hit("b")))
        if CROWD is None:
            return self._best(out)
        if not (crowded := self.numbers.where(~alone)).isEmpty():
            out = out.unionByName(self._beside_partner(mine, crowded.select("key", "entity")).select("profile", "entity", no_name, none.alias("hit_a"), none.alias("hit_b")))
        if not (crowded := self.holders.where(~alone)).isEmpty():
            met = scored.join(crowded.select("e_plain").distinct(), "e_plain", "left_semi")
            left = salted_join(self.profiles.select("profile", "plain", "partners").where("plain is not null"), met, "plain", "inner", F.col("profile"), hot=self.hot).select("profile", "partners", F.col("e_plain").alias("key"), "near")
            out = out.unionByName(self._beside_partner(left, crowded.select(F.col("e_plain").alias("key"), "entity")).select("profile", "entity", "near", none.alias("hit_a"), none.alias("hit_b")))
        return self._best(out)

    @staticmethod
    def _best(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("profile", "entity").agg(F.max("near").alias("near"), F.max("hit_a").alias("hit_a"), F.max("hit_b").alias("hit_b"))

    def similarities(self, pairs: DataFrame) -> DataFrame:
        """``profile, entity, key, n, cls``: the pattern of similarities of each pair of ``candidates``; ``cls`` is the plain name of the record."""
        full = pairs.join(self.profiles, "profile")
        met = full.select("profile", "entity", F.explode("partners").alias("partner")).select("profile", "entity", F.concat_ws("|", "entity", "partner").alias("pair"))
        met = met.join(self.partners.select("pair").distinct(), "pair", "left_semi").select("profile", "entity").distinct().withColumn("met", F.lit(1.0))
        full = salted_join(full.join(met, ["profile", "entity"], "left"), self.entities, "entity", "left", F.col("profile"))
        c = F.col
        best = F.coalesce("near", _alike(c("plain"), c("prefix"), c("stem"), c("u.e_plain"), c("u.e_prefix"), c("u.e_stem")))
        registry = lambda k: F.when((F.size(k) > 0) & (F.coalesce(f"has_{k}", F.lit(0)) == 1), c(f"hit_{k}").cast("double"))
        full = full.withColumn("best", best)
        x = F.array(c("best.stem"), c("best.prefix"), registry("a"), registry("b"), F.when(F.size("partners") > 0, F.coalesce("met", F.lit(0.0))))
        key = F.array_join(F.transform(x, lambda v: F.coalesce(F.round(v * STEPS).cast("int").cast("string"), F.lit("-"))), ",")
        return full.select("profile", "entity", key.alias("key"), "n", F.col("plain").alias("cls"))

    def kinship(self) -> DataFrame:
        """``profile, fa, fb, others``: whether a record shares its numbers with other records of its name (1), contradicts them (0) or can't be compared (null), and how many those are."""
        p = self.profiles.where("plain is not null")
        size = p.groupBy("plain").agg(F.sum("n").alias("size"), F.count_if(F.size("a") > 0).alias("na"), F.count_if(F.size("b") > 0).alias("nb"))
        keys = F.concat(F.transform("a", lambda v: F.concat(F.lit("a|"), v)), F.transform("b", lambda v: F.concat(F.lit("b|"), v)))
        each = p.select("profile", "plain", F.explode(keys).alias("k")).select("profile", F.substring("k", 1, 1).alias("kind"), F.concat_ws("|", "plain", "k").alias("pk"))
        shared = each.groupBy("pk").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("pk", F.lit(1).alias("more"))
        hit = salted_join(each, shared, "pk", "inner", F.col("profile")).groupBy("profile").agg(F.max((F.col("kind") == "a").cast("int")).alias("sa"), F.max((F.col("kind") == "b").cast("int")).alias("sb"))
        j = salted_join(p.select("profile", "plain", "n", F.size("a").alias("ka"), F.size("b").alias("kb")), size.where(F.col("size") > 1), "plain", "inner", F.col("profile"), hot=self.hot).join(hit, "profile", "left")
        flag = lambda k: F.when(F.coalesce(f"s{k}", F.lit(0)) == 1, 1).when((F.col(f"k{k}") > 0) & (F.col(f"n{k}") > 1), 0).alias(f"f{k}")
        return j.select("profile", flag("a"), flag("b"), (F.col("size") - F.col("n")).alias("others")).where("others > 0")


def _named(names: DataFrame) -> DataFrame:
    return names.withColumn("p", name_parts("name")).select("*", "p.plain", "p.prefix", "p.stem").drop("p").where("plain <> ''")


def _patterns(scored: DataFrame) -> DataFrame:
    """Equal evidence counted: at most as many entries for a record as there are patterns and levels, whatever the number of its candidates."""
    each = scored.groupBy("profile", "n", "key", "bound").agg(F.count(F.lit(1)).alias("times"))
    own = each.groupBy("profile", "n").agg(F.sort_array(F.collect_list(F.struct("key", "bound", "times"))).alias("vectors"))
    return own.groupBy("vectors").agg(F.sum("n").alias("n"))


def _beliefs(scored: DataFrame, model: Mixture, bounded: bool = True) -> DataFrame:
    """``scored`` with the posterior ``g`` of each pair under both constraints, by sums per record. The patterns are at most (STEPS + 1) x 2 x 27, so that their odds may be broadcast."""
    keys = [r.key for r in scored.select("key").distinct().collect()]
    odds = np.clip(model.log_odds(np.array([vector(k) for k in keys])), -300, 300) if keys else []
    table = scored.sparkSession.createDataFrame([(k, float(math.exp(o))) for k, o in zip(keys, odds)], "key string, e double")
    j = scored.join(F.broadcast(table), "key")
    sums = j.groupBy("profile").agg(F.sum("e").alias("all"))
    j = j.join(sums, "profile").withColumn("own", F.col("e") / (1 + F.col("all"))).withColumn("least", F.col("bound") / LEVELS)
    if not bounded:
        return j.select(*scored.columns, F.col("own").alias("g"))
    raised = F.col("least") > F.col("own")
    asked = j.groupBy("profile").agg(F.sum(F.when(raised, F.col("least")).otherwise(0.0)).alias("asked"), F.sum(F.when(raised, F.col("own")).otherwise(0.0)).alias("had"))
    j = j.join(asked, "profile")
    g = F.when(raised, F.col("least") / F.greatest("asked", F.lit(1.0))).otherwise(F.col("own") * F.greatest(1 - F.col("asked"), F.lit(0.0)) / F.greatest(1 - F.col("had"), F.lit(1e-12)))
    return j.select(*scored.columns, F.when(F.col("asked") > 0, g).otherwise(F.col("own")).alias("g"))


def _bounds(evidence: _Evidence, kin: DataFrame, scored: DataFrame, model: Mixture, bounded: bool) -> DataFrame:
    """``scored`` with what transitivity demands of each pair, in steps of 1 / LEVELS, and with the pairs that a record meets through its class only."""
    held = settle(_beliefs(scored, model, bounded), "beliefs")
    mass = held.where("cls is not null and g > 0.001").groupBy("cls", "entity").agg(F.sum(F.col("n") * F.col("g")).alias("mass"))
    mass = settle(mass.withColumn("ce", F.concat_ws("|", "cls", "entity")), "mass")
    flags = [(fa, fb, 1 / (1 + math.exp(-float(np.clip(model.log_odds(np.array([[1, 1, math.nan if fa is None else fa, math.nan if fb is None else fb, math.nan]]))[0], -300, 300))))) for fa in (None, 0, 1) for fb in (None, 0, 1)]
    same = evidence.profiles.sparkSession.createDataFrame(flags, "ga int, gb int, same double")  # nine rows
    trust = kin.join(F.broadcast(same), F.col("fa").eqNullSafe(F.col("ga")) & F.col("fb").eqNullSafe(F.col("gb"))).select("profile", "others", "same")
    # records whose class leans to an entity that isn't among their candidates
    sizes = evidence.profiles.where("plain is not null").groupBy(F.col("plain").alias("cls")).agg(F.sum("n").alias("size"))
    leaning = mass.join(sizes, "cls").where(F.col("mass") >= F.col("size") / 2).select(F.col("cls").alias("plain"), "entity")
    met = salted_join(evidence.profiles.select("profile", "plain").where("plain is not null"), leaning, "plain", "inner", F.col("profile"), hot=evidence.hot).select("profile", "entity")
    none = F.lit(0)
    more = met.join(scored.select("profile", "entity"), ["profile", "entity"], "left_anti").select("profile", "entity", F.lit(None).cast("struct<sum:double,stem:double,prefix:double>").alias("near"), none.alias("hit_a"), none.alias("hit_b"))
    more = settle(more, "met")
    if not more.isEmpty():
        held = held.unionByName(evidence.similarities(more).withColumn("bound", none).withColumn("g", F.lit(0.0)))
    heavy = [r.ce for r in mass.where(F.col("mass") >= max(2.0, HOT_SHARE * evidence.rows)).select("ce").collect()]  # 1 / HOT_SHARE at most
    j = salted_join(held.drop("bound").withColumn("ce", F.concat_ws("|", "cls", "entity")), mass.select("ce", "mass"), "ce", "left", F.col("profile"), hot=heavy).join(trust, "profile", "left")
    level = F.floor(LEVELS * F.coalesce(F.col("same") * (F.col("mass") - F.col("n") * F.col("g")) / F.col("others"), F.lit(0.0)) + 1e-9)
    return settle(j.select("profile", "entity", "key", "n", "cls", F.least(F.greatest(level, none), F.lit(LEVELS)).cast("int").alias("bound")), "bounds")


def match(records: DataFrame, entities: DataFrame, rc: Columns, ec: Columns, threshold: float = 0.5, most: int = 8) -> DataFrame:
    """``key, entity, confidence``: the entity that each record means, where one is more likely than ``threshold``.

    A record without name and numbers, or without candidate, has no match. Missing attributes count neither way.
    Records with equal attributes get equal answers; of equally likely entities the smaller id is taken. Repeated rows
    of either table change nothing but the counts the mixture is fitted to. Empty tables give no rows. The mixture is
    fitted again each time the bounds of transitivity have moved; a warning tells if they still move after ``most`` fits.
    Every entity that has a record's number or name is a candidate, unless ``CROWD`` sets a rule for what many share.
    """
    rows = records.select(
        F.col(f"`{rc.key}`").alias("key"),
        F.col(f"`{rc.name}`").cast("string").alias("name"),
        F.array_sort(F.array_distinct(F.coalesce(_numbers(rc.registry_a), F.array().cast("array<string>")))).alias("a"),
        F.array_sort(F.array_distinct(F.coalesce(_numbers(rc.registry_b), F.array().cast("array<string>")))).alias("b"),
        _partner_keys(rc).alias("partners"),
    ).where("key is not null").withColumn("profile", F.sha2(F.to_json(F.struct(F.coalesce("name", F.lit("")).alias("n"), "a", "b", "partners")), 256).substr(1, 32))
    evidence = _Evidence(rows, entities, ec)
    scored = settle(evidence.similarities(evidence.candidates()).withColumn("bound", F.lit(0)), "pairs")
    kin = settle(evidence.kinship(), "kin")
    model = None
    for _ in range(most):
        patterns = settle(_patterns(scored), "patterns")
        if patterns.isEmpty():
            model = Mixture(cov=[[np.eye(len(b)) for b in BLOCKS]] * 2)
            break
        before, model = model, fit(patterns.coalesce(8), model)
        forget(patterns)
        if before is not None and np.allclose(model.mean, before.mean, atol=0.01) and abs(model.share - before.share) < 0.01:
            break  # the bounds were made by a model like this one
        scored = _bounds(evidence, kin, scored, model, before is not None)
    else:
        warnings.warn(f"the bounds of transitivity still move after {most} fits; those of the last one are used", stacklevel=2)
    best = _beliefs(scored, model).groupBy("profile").agg(F.min(F.struct((-F.round("g", 9)).alias("minus"), "entity")).alias("b"))
    best = best.select("profile", "b.entity", (-F.col("b.minus")).alias("confidence")).where(F.col("confidence") > threshold)
    return salted_join(rows.select("key", "profile"), best.select("profile", "entity", F.round("confidence", 6).alias("confidence")), "profile", "inner", F.col("key")).select("key", "entity", "confidence").distinct()
