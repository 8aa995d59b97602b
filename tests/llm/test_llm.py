"""Matching, look-alikes, encoding, leakage and sentences, against brute force, exact round trips and hand-made cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandmill.llm import encoding as E
from strandmill.llm import leakage as L
from strandmill.llm import lookalike as K
from strandmill.llm import matching as M
from strandmill.llm import sentences as S


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# look-alikes


@pytest.mark.parametrize(
    "a, b",
    [("Koruspira refovora", "Ｋｏｒｕｓｐｉｒａ　ｒｅｆｏｖｏｒａ"), ("α-x", "ɑ-x"), ("β-x", "ꞵ‑x"), ("fine", "ﬁne"), ("Dokulla bíbitica", "Dokulla bíbitica"), ("isomer", "i​so­mer️"), ("Векатор", "Beкатop"), ("a b", "a b"), ("Nova", "Νονa"), ("Ångström", "Ångström"), ("x-y", "x－y")],
)
def test_looks_the_same(a, b):
    assert K.skeleton(a) == K.skeleton(b) and K.skeleton(K.skeleton(a)) == K.skeleton(a)


@pytest.mark.parametrize("a, b", [("ꓐꓳꓔ", "BOT"), ("Ꮯꮯ", "Cc"), ("ᑭᗅᖇ", "PAR"), ("m๐n၀", "mono"), ("Ƅ", "Ь"), ("a‧b", "a·b"), ("ⲀⲎⲞ", "AHO"), ("℮x", "ex")])
def test_more_scripts_look_the_same(a, b):
    assert K.skeleton(a) == K.skeleton(b) and K.skeleton(K.skeleton(a)) == K.skeleton(a)


def test_public_table_may_be_read(tmp_path):
    (tmp_path / "c.txt").write_text("\ufeff# header\n0430 ;\t0061 ;\tMA\t# x\n0031 ;\t006C ;\tMA\n1D6A ;\t0071 0075 ;\tMA\n0061 0062 ; 0063 ; MA\n")
    assert K.read_confusables(str(tmp_path / "c.txt")) == {"а": "a", "ᵪ": "qu"}


@pytest.mark.parametrize("a, b", [("x2", "x²"), ("x2", "x₂"), ("Abc", "abc"), ("bibitica", "bíbitica"), ("alpha-x", "α-x"), ("a b", "a  b"), ("ab", "a b"), ("l1", "ll"), ("O0", "00")])
def test_looks_different(a, b):
    assert K.skeleton(a) != K.skeleton(b)


def test_twins(spark):
    nodes = spark.createDataFrame([("N2", "Name x"), ("N1", "Nаme x"), ("N3", "Name x"), ("N4", "Name x"), ("N4", "Name x"), ("N5", None), ("N6", "​"), ("N7", "‌"), ("N8", "other")], "id string, name string").withColumn("skeleton", F.lit(1))
    got = rows(K.twins_within(nodes))
    assert got == [("N1", "N2"), ("N1", "N3"), ("N1", "N4"), ("N2", "N3"), ("N3", "N4")]
    classes = K.twin_classes(nodes).collect()
    assert sorted(r.id for r in classes) == ["N1", "N2", "N3", "N4"] and {(r.class_id, r.n_spellings, r.n_ids) for r in classes} == {("N1", 3, 4)}
    assert K.twin_classes(nodes.limit(0)).count() == 0
    r = spark.createDataFrame([(1, "Name x"), (2, "Ｎame x"), (2, "Ｎame x"), (3, None), (4, "name x")], "row_key int, name string")
    assert rows(K.twins_by_name(r, nodes.where("id in ('N2', 'N8')"))) == [("2", "N2")]
    c = spark.createDataFrame([("c1", "N2", "Name x"), ("c2", "N2", "Nаme x"), ("c3", "N8", "Name x"), ("c4", None, "x"), ("c5", "zz", "x")], "row_key string, id string, name string")
    assert rows(K.twins_by_id(c, nodes)) == [("c2", "N2")]
    for empty in (K.twins_within(nodes.limit(0)), K.twins_by_name(r.limit(0), nodes), K.twins_by_id(c, nodes.limit(0))):
        assert empty.count() == 0


# matching


@pytest.mark.parametrize(
    "name, plain, parts",
    [
        ("6-ethylfibuvunic  acid", "6-ethylfibuvunate", ("6-ethyl", "fibuvunate")),
        ("vupalonamide, 5-tydroxy-", "5-tydroxyvupalonamide", ("5-hydroxy", "vupalonamide")),
        ("6-Me-taludenal", "6-methyltaludenal", ("6-methyl", "taludenal")),
        ("betazikipidione", "β-zikipidione", ("β-", "zikipidione")),
        ("N acetyl lazusinate", "n-acetyl-lazusinate", ("n-acetyl-", "lazusinate")),
        ("N-acetyl-rofobilactone [serum]", "n-acetyl-rofobilactone", ("n-acetyl-", "rofobilactone")),
        ("5-hydroxyvileronate sodium salt (x)", "5-hydroxyvileronate", ("5-hydroxy", "vileronate")),
        ("zoliponine, 3-hydroxy-", "3-hydroxyzoliponine", ("3-hydroxy", "zoliponine")),
        ("ISOsavubunamides", "isosavubunamide", ("iso", "savubunamide")),
        ("CT-100", "", ("", "")),
        (None, "", ("", "")),
        ("   ", "", ("", "")),
    ],
)
def test_plain_names(name, plain, parts):
    assert M.plain_name(name) == plain and M.split_name(plain) == parts


def test_near_keys_find_one_edit():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(3, 9)))
        b = "".join(rng.choice("abcd") for _ in range(rng.randint(3, 9)))
        if M._edits(a, b) <= 1:
            assert set(M.near_keys(a)) & set(M.near_keys(b))


def _substances(rng, n):
    stems = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) + "none" for _ in range(n)]
    return [(f"M{i}{k}", f"{p}{s}", f"CHEBI:{1000 + i * 4 + k}", f"C{5000 + i * 4 + k}") for i, s in enumerate(stems) for k, p in enumerate(("2-hydroxy", "3-hydroxy", "α-", "iso"))]


def test_matching_recovers_planted_truth(spark):
    rng = random.Random(4)
    subs = _substances(rng, 60)
    genes = {m: [f"{rng.randint(1, 500)}" for _ in range(5)] for m, *_ in subs}
    chains, recs, truth = [], [], {}
    for m, name, a, b in subs:
        if m.endswith("1"):
            continue  # isomers that the chains lack
        for g in genes[m]:
            chains.append((m, name if rng.random() > 0.1 else None, a if rng.random() > 0.4 else "NA", b if rng.random() > 0.4 else None, f"NCBIGene:{g}", f"G{g}"))
    for i in range(400):
        m, name, a, b = subs[rng.randint(0, 5)] if i % 3 == 0 else rng.choice(subs)  # a few hold a third
        style = rng.randint(0, 4)
        shown = [name, name.upper(), name.replace("-", " "), name[:-3] + name[-2:], name + " [serum]"][style]
        wrong = rng.choice(subs)
        recs.append((i, shown if rng.random() > 0.1 else None, (a if rng.random() > 0.05 else wrong[2]) if rng.random() > 0.4 else None, b if rng.random() > 0.3 else None, rng.choice(genes[m]), None))
        truth[i] = None if m.endswith("1") else m
    c = spark.createDataFrame(chains, "metabolite_id string, metabolite_name string, chebi string, kegg string, gene string, symbol string").withColumn("entity", F.lit("clash")).withColumn("profile", F.lit(0))
    r = spark.createDataFrame(recs + recs[:10], "row_index int, metabolite string, chebi string, kegg string, gene_id string, gene string").withColumn("key", F.lit("clash")).withColumn("n", F.lit(0))
    rc, ec = M.Columns("row_index", "metabolite", "chebi", "kegg", "gene_id", "gene"), M.Columns("metabolite_id", "metabolite_name", "chebi", "kegg", "gene", "symbol")
    out = M.match(r, c, rc, ec).collect()
    got = {x.key: x.entity for x in out}
    assert len(got) == len(out) and all(0.5 < x.confidence <= 1 for x in out)
    telling = [i for i, x in enumerate(recs) if x[1] or x[3]]
    right = sum(got.get(i) == truth[i] for i in telling if truth[i])
    wrong = sum(i in got and got[i] != truth[i] for i in truth)
    assert right / sum(truth[i] is not None for i in telling) > 0.95 and wrong <= 0.04 * len(got)
    sure = sum(x.confidence for x in out) / len(out)
    assert abs(sure - (1 - wrong / len(got))) < 0.05  # the confidence is what it says
    assert M.match(r.limit(0), c, rc, ec).count() == 0
    assert M.match(r, c.limit(0), rc, ec).count() == 0


def test_at_most_one_match_per_record():
    import numpy as np

    post = M._share_out(np.array([3.0, 3.0, -2.0, 800.0]), np.array([0, 0, 0, 1]))
    assert post[:3].sum() < 1 and abs(post[0] - post[1]) < 1e-12 and post[3] > 0.99


def test_transitivity_in_the_shared_belief():
    import numpy as np

    odds, group = np.array([2.0, 1.0, -3.0]), np.array([0, 0, 1])
    free = M._share_out(odds, group)
    bound = M._share_out(odds, group, bound=np.array([0.0, 0.9, 0.0]))
    assert bound[1] == 0.9 and 0 < bound[0] < free[0] and bound[:2].sum() < 1 and bound[2] == free[2]
    assert np.allclose(M._share_out(odds, group, bound=np.zeros(3)), free)
    assert np.isclose(M._share_out(np.array([1.0]), np.array([0]), np.array([3.0]))[0], M._share_out(np.ones(3), np.zeros(3, dtype=int))[0])


def test_fit_overturns_the_first_guess(spark):
    import numpy as np

    one = lambda *keys: [(k, 0, 1) for k in keys]
    true, decoy = "9,20,20,20,0", "20,20,0,-,20"  # both numbers agree and the names little; the names agree and a number contradicts
    data = [(one("20,20,20,20,20", "8,0,0,-,0"), 300), (one("20,20,0,0,0"), 200), (one("10,20,20,20,20"), 100), (one(true, decoy), 40)]
    patterns = spark.createDataFrame(data, "vectors array<struct<key:string,bound:int,times:long>>, n long")
    rate = lambda k: np.nanmean(M.vector(k)) - 0.6
    assert rate(decoy) > rate(true)  # what the first round takes for the match
    model = M.fit(patterns)
    a, b = model.log_odds(np.array([M.vector(true), M.vector(decoy)]))
    assert a > 0 > b
    with pytest.raises(M.NotConverged):
        M.fit(patterns, most=1)


def test_records_of_one_name_are_matched_alike(spark):
    rc, ec = M.Columns("row_index", "metabolite", "chebi", "kegg", "gene_id", "gene"), M.Columns("metabolite_id", "metabolite_name", "chebi", "kegg", "gene", "symbol")
    subs = _substances(random.Random(3), 20)
    chains = [(m, name, a, b, f"NCBIGene:{i}", f"G{i}") for i, (m, name, a, b) in enumerate(subs)]
    recs = [(i, name, a, b, str(i), None) for i, (_, name, a, b) in enumerate(subs)]
    recs += [(100 + i, "trivialname", subs[5][2], subs[5][3], "5", None) for i in range(3)] + [(110, "trivialname", subs[5][2], None, "5", "X")]
    recs += [(200, "Trivialname", None, None, "77", None), (201, "unknownname", None, None, "5", None)]  # nothing in common with the entity but the class
    c = spark.createDataFrame(chains, "metabolite_id string, metabolite_name string, chebi string, kegg string, gene string, symbol string")
    r = spark.createDataFrame(recs, "row_index int, metabolite string, chebi string, kegg string, gene_id string, gene string")
    got = {x.key: x.entity for x in M.match(r, c, rc, ec).collect()}
    assert got[200] == subs[5][0] and 201 not in got and all(got[i] == m for i, (m, *_) in enumerate(subs))


def test_keys_of_many_entities_lead_to_all_of_them(spark):
    ec = M.Columns("metabolite_id", "metabolite_name", "chebi", "kegg", "gene", "symbol")
    chains = [(f"M{i}", "placeholdername" if i < 120 else f"name{i}x", "CHEBI:99999" if i >= 20 else None, None, f"NCBIGene:{i}", None) for i in range(140)]
    c = spark.createDataFrame(chains, "metabolite_id string, metabolite_name string, chebi string, kegg string, gene string, symbol string")
    rows_ = spark.createDataFrame([("500", None, ["99999"], [], ["i70"]), ("501", "placeholdername", [], [], [])], "profile string, name string, a array<string>, b array<string>, partners array<string>")
    found = M._Evidence(rows_, c, ec)
    pairs = {(x.profile, x.entity): x.hit_a for x in found.candidates().collect()}
    assert pairs == {("500", f"M{i}"): 1 for i in range(20, 140)} | {("501", f"M{i}"): 0 for i in range(120)}
    assert found.entities.where("has_a = 1").count() == 120


def test_crowded_keys_need_a_partner(spark, monkeypatch):
    monkeypatch.setattr(M, "CROWD", 5)
    rc, ec = M.Columns("row_index", "metabolite", "chebi", "kegg", "gene_id", "gene"), M.Columns("metabolite_id", "metabolite_name", "chebi", "kegg", "gene", "symbol")
    subs = _substances(random.Random(3), 20)
    chains = [(m, name if i > 12 else "placeholdername", a if i < 60 else "CHEBI:99999", b, f"NCBIGene:{i}", f"G{i}") for i, (m, name, a, b) in enumerate(subs)]
    recs = [(i, name, a, b, str(i), None) for i, (_, name, a, b) in enumerate(subs)] + [(500, None, "CHEBI:99999", None, "70", None), (501, "placeholdername", None, None, "3", None)]
    c = spark.createDataFrame(chains, "metabolite_id string, metabolite_name string, chebi string, kegg string, gene string, symbol string")
    r = spark.createDataFrame(recs, "row_index int, metabolite string, chebi string, kegg string, gene_id string, gene string")
    rows_ = r.select(F.col("row_index").cast("string").alias("profile"), F.col("metabolite").alias("name"), F.array_compact(F.array(F.regexp_extract("chebi", "([0-9]+)", 1))).alias("a"), F.array_compact(F.array(F.regexp_extract("kegg", "([0-9]+)", 1))).alias("b"), F.array(F.concat(F.lit("i"), "gene_id")).alias("partners"))
    pairs = {(x.profile, x.entity) for x in M._Evidence(rows_, c, ec).candidates().collect()}
    assert {e for p, e in pairs if p == "500"} == {subs[70][0]} and {e for p, e in pairs if p == "501"} == {subs[3][0]}
    assert M.match(r, c, rc, ec).count() >= 60


# encoding

VOCABULARY = os.path.join(os.environ.get("STRANDMILL_TOKENIZERS", E.TOKENIZERS), "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return E.Encoder.parse(f.read())


def test_encoding_equals_the_public_tokenizer(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rng = random.Random(2)
    alphabet = "aeioustrn ABC019.,;'\n\t  éüñßœ中文字ひらカタاللحियаяไทย🧫∑‍́"
    texts = ["", " ", "hello world", "<|endoftext|> it's we'll", "ａｂｃ", "a" * 3000, "中" * 2000, "\n\n\n  x", "été déjà"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for text in texts:
        assert encoder.encode(text) == t.encode(text, add_special_tokens=False).ids, text[:50]


def test_encoding_round_trip_and_fragments(encoder):
    back = {v: k for k, v in encoder.ranks.items()}
    text = "Δ9-tetra-hydro… 第3章 ∮ e=mc² 🧬🧬"
    assert b"".join(back[i] for i in encoder.encode(text)).decode() == text
    for piece in (b"abc", "中文字符".encode(), b"\xff\x00\xff"):
        assert b"".join(encoder.fragments(piece)) == piece


def test_encode_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (None, "x"), (1, "hello world")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = E.encode_texts(df, "doc_id", "text", VOCABULARY)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted(((r.doc_id, tuple(r.ids)) for r in got.collect()), key=repr) == sorted([(1, (31373, 995)), (1, (31373, 995)), (2, ()), (3, ()), (None, (87,))], key=repr)
    assert E.encode_texts(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0
    long = spark.createDataFrame([(i, "word " * 900_000 if i % 2 else "") for i in range(6)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.n for r in E.encode_texts(long, "doc_id", "text", VOCABULARY).select("doc_id", F.size("ids").alias("n")).collect()} == {i: 900_001 if i % 2 else 0 for i in range(6)}


# leakage


def brute_leak(text, item, rule, units):
    a, b = units(text), units(item)
    for i in range(len(a)):
        for j in range(len(b)):
            wrong = 0
            for k in range(min(len(a) - i, len(b) - j)):
                wrong += a[i + k] != b[j + k]
                n = k + 1
                if n >= rule.least and wrong * rule.one_in <= n and a[i] == b[j] and a[i + k] == b[j + k]:
                    return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 40)))) for i in range(12)]
    texts = []
    for d in range(250):
        _, it = rng.choice(items)
        w = it.split()
        n = rng.randint(8, 24)
        s = rng.randint(0, max(0, len(w) - n))
        part = w[s : s + n]
        for k in range(len(part)):
            if rng.random() < 0.1:
                part[k] = "zzz"
        texts.append((d, " ".join([rng.choice(vocabulary) for _ in range(10)] + [p.upper() + "," for p in part] + [rng.choice(vocabulary) for _ in range(10)])))
    want = sorted(((d, i) for d, t in texts for i, it in items if brute_leak(t, it, L.WORDS, L.words)), key=repr)
    docs, its = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(L.leaks(docs, its, "doc_id", "text", "item_id", "text").where("exact"), "doc_id", "item_id") == want
    assert 50 < len(want) < 250


def full_alignment(text, item):
    best, above = 0, [0] * (len(text) + 1)
    for u in item:
        row = [0]
        for j, t in enumerate(text, 1):
            row.append(max(0, above[j - 1] + (1 if t == u else -1), above[j] - 2, row[-1] - 2))
        best, above = max(best, *row), row
    return best


def test_edited_copies_are_found(spark):
    item = [f"i{k}" for k in range(24)]
    cases = {
        1: item[:8] + ["new"] + item[8:16] + ["other"] + item[16:],  # two words added
        2: item[:8] + item[9:16] + item[17:],  # two words left out
        3: ["sub" if k in (7, 15) else w for k, w in enumerate(item)],  # two exchanged: a passage
        4: item[:6] + ["a", "b", "c"] + item[6:9],  # too little
        5: item[:9] + ["x"] + ["y" if k == 14 else w for k, w in enumerate(item)][9:],
        6: item[::-1],
    }
    docs = spark.createDataFrame([(k, " ".join(["p", "q", *w, "r"])) for k, w in cases.items()], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.exact) for r in L.leaks(docs, items, "doc_id", "text", "item_id", "text").collect()}
    assert {d for d, _ in got} == {1, 2, 3, 5} and len(got) == 8
    assert {d for (d, _), (_, exact) in got.items() if exact} == {3, 5}  # in 5 the fifteen words after the added one are a passage
    for (d, _), (score, _) in got.items():
        assert score == full_alignment(cases[d], item)


def test_band_scores_equal_full_alignment():
    import numpy as np

    rng = random.Random(2)
    texts = [np.array([rng.randint(1, 9) for _ in range(rng.randint(1, 9))], dtype=np.uint64) for _ in range(200)]
    items = [np.array([rng.randint(1, 9) for _ in range(rng.randint(1, 6))], dtype=np.uint64) for _ in range(200)]
    got = L.alignment_scores(L.windows(texts, items, [0] * 200)).tolist()  # the band holds all diagonals of texts so short
    assert got == [full_alignment(t[: len(i) + L.BAND].tolist(), i.tolist()) for t, i in zip(texts, items)]


def test_rare_seeds_cover_every_passage():
    rng = random.Random(6)
    for _ in range(300):
        counts = [rng.choice([0, 1, 5, 100]) for _ in range(rng.randint(1, 9))]
        kept = L.rarest(counts)
        covers = [s for n in range(1 << len(counts)) if all(n >> k & 3 for k in range(len(counts) - 1)) and (s := sum(c for k, c in enumerate(counts) if n >> k & 1)) >= 0]
        assert len(counts) == 1 or (all({k, k + 1} & set(kept) for k in range(len(counts) - 1)) and sum(counts[k] for k in kept) == min(covers))
    for rule in L.RULES:
        for n in range(rule.least, 200):
            m = n // rule.one_in
            assert -(-(n - m) // (m + 1)) >= rule.run >= rule.seed + 1
            for _ in range(20):
                wrong = set(rng.sample(range(1, n - 1), m)) if rng.random() < 0.5 else set(range(a := rng.randint(1, n - 1 - m), a + m))
                assert max(sum(k not in wrong for k in range(a, a + rule.least)) for a in range(n - rule.least + 1)) >= rule.close


def found_pairs(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    its = spark.createDataFrame(items, "item_id long, text string")
    return rows(L.leaks(docs, its, "doc_id", "text", "item_id", "text").where("exact"), "doc_id", "item_id")


def test_chinese_leaks(spark):
    item = "如果Tipubacter mefevora把L-monosonate转化为6-methyldupivonol，同时WVFL8被dudolar抑制，那么63天后rogupor的含量会怎样变化？"
    other = "如果Zadabacter pazetica把5-hydroxyzoliponine转化为L-kerasadione，同时QVSI2被zalosar抑制，那么4天后zebozol的含量会怎样变化？"
    assert found_pairs(spark, ["旧笔记中写着“" + item[20:60].replace("，", "\n") + "”这句话。", other], [(7, item)]) == [(0, 7)]
    assert L.by_letters(item) and not L.by_letters("plain words") and not L.by_letters("")


def test_seeds_across_texts_do_not_count(spark):
    item = " ".join(f"i{k}" for k in range(14))
    halves = [" ".join(item.split()[:7]), " ".join(item.split()[7:])]
    assert found_pairs(spark, halves + [item], [(1, item)]) == [(2, 1)]


def test_very_long_text(spark):
    item = " ".join(f"i{k}" for k in range(14))
    long = "filler words " * 150_000 + item + " more" * 100_000
    assert found_pairs(spark, [long, "x"], [(1, item)]) == [(0, 1)]


def test_chinese_full_of_latin_names(spark):
    item = "如果Lumospira zuzaphilus把2-hydroxydedivenol转化为2-hydroxyluniminoside，同时OEDQ8被livalar抑制，那么55天后mibapar的含量会怎样变化？"  # item 1496
    docs = spark.createDataFrame([(4641, "旧笔记：" + item), (1, "plain words only")], "doc_id long, text string")
    items = spark.createDataFrame([(1496, item, "zh")], "item_id long, text string, lang string")
    assert rows(L.leaks(docs, items, "doc_id", "text", "item_id", "text"), "doc_id", "item_id") == [(4641, 1496)]
    assert rows(L.leaks(docs, items, "doc_id", "text", "item_id", "text", item_lang="lang"), "doc_id", "item_id") == [(4641, 1496)]
    mostly = "一 Lumospira zuzaphilus hydroxydedivenol hydroxyluniminoside"
    assert L.by_letters(mostly, "zh") and not L.by_letters(mostly, "en") and not L.by_letters("plain words", "zh")


def test_leaks_on_tables(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, "x " + item.upper().replace(" ", "\r\n")), (2, None), (3, ""), (4, "one two three"), (1, "x " + item), (5, item.replace("six", "sex"))], "doc_id long, text string").withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(10, item), (11, None), (12, "short"), (10, item)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    assert rows(L.leaks(docs, items, "doc_id", "text", "item_id", "text"), "doc_id", "item_id") == [(1, 10), (5, 10)]
    assert L.leaks(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert L.leaks(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0


# sentences


@pytest.mark.parametrize(
    "text",
    [
        "Dr. Roz kept b. tivanis at 4.5 °C, i.e. cold.|See Fig. 3 and Suppl. Table 5 for R. tivanis.|Was it needed?!|Yes!",
        "U.S. and E.U. rules differ.|The racks held plates, tubes, etc.|Next came more.|It read set_67.csv, e.g. twice (cf. Zul et al. 1990).",
        "“Does it matter?” asked the reader.|The reader asked: “Does it matter?”|Growth rose.",
        "The note said \"No. 4 is void.\" and was filed.|2.8 ml of broth, vs. 7.5 ml before, was enough.",
        "„Wirkt es überhaupt?“, fragte Dr. Got.|Am 12. Mai 2019 wurde Probe Nr. 4 verworfen.|Das gilt z. B. für B. vazilum.|Geräte usw. wurden gereinigt.",
        "On attendit… puis le taux a doublé.|« Est-ce utile ? » demanda le Dr Lip.|Le relecteur écrit : « Est-ce utile ? »|Quelle surprise !",
        "Esperamos... y luego bajó.|«¿Es útil?», preguntó la Dra. Dez.|EE. UU. aplica otra norma.|¿Actúa sobre QVSI9?",
        "См. рис. 4 и табл. 5 (ок. 2,5 мг).|«Нужен ли он?» — спросил рецензент.|Это верно, т. е. равно 5 %.|В 2020 г. было взято 7 проб.",
        "“क्या यह ज़रूरी है?” समीक्षक ने पूछा।|हम रुके... और फिर स्तर घट गया।|33.81 मि.ग्रा. दिया गया।",
        "«هل هي ضرورية؟» سأل المراجع.|قال د. Seviki إن Migebacter finelum غير موجودة.",
    ],
)
def test_spaced_sentences(text):
    parts = text.split("|")
    joined = " ".join(parts)
    assert [joined[a:b] for a, b in S.sentence_spans(joined)] == parts
    wrapped = "\n".join(parts)
    assert [wrapped[a:b] for a, b in S.sentence_spans(wrapped)] == parts


@pytest.mark.parametrize(
    "text",
    [
        "他说：“不必重复。”然后离开了实验室。|“X真的有用吗？”审稿人问道。|审稿人问道：“X真的有用吗？”|我们一直等……后来QVSI5增加一倍。|剂量为36.1 mg，约为之前的2.5倍。|见图4（p = 0.2），菌株为V. vifudens。",
        "「Xは必要か？」と査読者は尋ねた．|査読者は「Xは必要だ。」と書いた。|待ち続けた……そしてYXXR7は低下した。|濃度は2．5 mMで、約2．5倍だった。",
    ],
)
def test_spaceless_sentences(text):
    parts = text.split("|")
    joined = "".join(parts)
    assert [joined[a:b] for a, b in S.sentence_spans(joined)] == parts


def test_thai_sentences():
    text = "ความเข้มข้นเท่ากับ 11.4 มิลลิโมลาร์ซึ่งสูงกว่าเดิม 2.5 เท่า เมื่อไม่มีเชื้อ Kifulla pofutica ระดับสารลดลง ดร.สมมุติกล่าวว่าไม่จำเป็น"
    got = [text[a:b] for a, b in S.sentence_spans(text)]
    assert got == ["ความเข้มข้นเท่ากับ 11.4 มิลลิโมลาร์ซึ่งสูงกว่าเดิม 2.5 เท่า", "เมื่อไม่มีเชื้อ Kifulla pofutica ระดับสารลดลง", "ดร.สมมุติกล่าวว่าไม่จำเป็น"]


# everyday sentences without marks, written for this test; "|" is a boundary and "_" a blank at one
UNMARKED = {
    "ja": "今日はとても寒いです|しかし明日は暖かくなるでしょう / 昨日友達と映画を見ました|そのあと一緒に夕食を食べました / 電車が遅れています|だから会議に間に合いません / この本は面白いですか|_私はまだ読んでいません / 駅まで歩きました|_それから電車に乗りました / 雨が降っています|_でも出かけます / 彼は学生です|_彼女は先生です / 資料を確認してください|_次に署名をお願いします / 薬を飲んだ|_それで熱が下がった / 会議は終わりました|_明日また連絡します",
    "zh": "你吃饭了吗|我还没有吃呢 / 今天天气很好啊|我们去公园吧 / 你知道他在哪里吗|_我找了很久 / 我们走吧|_他已经到了 / 这个问题很难吗|_请再说一遍 / 他来了|_我们开始吧 / 他们昨天到了|_今天休息 / 这样可以吗|那我先走了 / 你别担心嘛|他会回来的",
    "th": "สวัสดีครับ|ผมชื่อสมชาย / วันนี้อากาศดีนะคะ|เราไปเที่ยวกัน / ขอบคุณค่ะ|ถ้ามีปัญหาโทรมา / กินข้าวหรือยังครับ|ผมหิวแล้ว / เขามาแล้วค่ะ|แต่เธอยังไม่มา",
}
WHOLE = ["東京 大阪 京都", "りんご バナナ みかん", "苹果 香蕉 橘子", "我们 的 家", "これは\nです", "他离开了\n我们的实验室", "对吧台很满意", "我们觉得\n这个问题很大"]


def unmarked_recall(lang, lattice):
    right = total = 0
    for case in UNMARKED[lang].split(" / "):
        parts = [p.lstrip("_") for p in case.split("|")]
        text = case.replace("|_", " ").replace("|", "")
        right += len({text[a:b] for a, b in S.sentence_spans(text, lattice)} & set(parts)) == len(parts)
        total += 1
    return right / total


def test_word_lattice_finds_unmarked_boundaries():
    full = S.Lattice.read(os.path.join(os.environ.get("STRANDMILL_TOKENIZERS", E.TOKENIZERS), "byte_bpe_multi_50k.tiktoken"))
    off = S.Lattice()
    off.cost, off.longest = {}, 1  # every letter a word of its own
    for lang, least in (("ja", 0.9), ("zh", 0.8), ("th", 1.0)):
        assert unmarked_recall(lang, full) >= least
    assert unmarked_recall("ja", off) <= 0.3 and unmarked_recall("th", off) <= 0.6
    for text in WHOLE:
        assert len(S.sentence_spans(text, full)) == 1, text


def test_lattice_takes_the_cheapest_words():
    lattice = S.Lattice({"研究": 10, "研究生": 500, "生命": 20, "命": 5000, "起源": 30, "的": 1, "生": 4000})
    text = "研究生命的起源"
    ends = lattice.ends(text)
    assert [text[a:b] for a, b in zip([0, *ends], ends)] == ["研究", "生命", "的", "起源"]
    assert S.Lattice().ends("") == [] and S.Lattice.read("/no/such/file").cost == S.Lattice().cost


def test_cost_depends_on_the_boundary_before():
    # the second mark follows no letter, so that only one of the two can end a sentence
    assert len(S.sentence_spans("It rose. . It fell.")) == 2
    # the same quotation begins a sentence or not
    parts = ["“Does it matter?” asked the reader.", "It said: “Does it matter?”", "“Yes?” said he."]
    text = " ".join(parts)
    assert [text[a:b] for a, b in S.sentence_spans(text)] == parts


def test_blank_lines_lists_and_run_together():
    text = "  Results\r\n\r\nIt rose\nslowly. It fell.Then it stopped.\n \n1. Did it act?\n2. Yes.\n\n\n"
    assert [text[a:b] for a, b in S.sentence_spans(text)] == ["Results", "It rose\nslowly.", "It fell.", "Then it stopped.", "1. Did it act?", "2. Yes."]
    for empty in (None, "", "  \n\t "):
        assert S.sentence_spans(empty) == []


def test_sentences_cover_the_text():
    rng = random.Random(8)
    alphabet = "ab AB.!?…。？「」“”()\n\n 中はไท1"
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        at, kept = 0, []
        for a, b in S.sentence_spans(text):
            assert at <= a < b <= len(text) and text[a:b] == text[a:b].strip()
            assert not text[at:a].strip()
            at = b
            kept.append(text[a:b])
        assert not text[at:].strip()


def test_long_paragraph_is_linear():
    text = "It rose. " * 60_000
    assert len(S.sentence_spans(text)) == 60_000
    assert len(S.sentence_spans("(" * 50_000 + "]" * 50_000)) == 1


def test_split_sentences(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, " "), (1, "A b. C d.")], "doc_id long, text string").withColumn("sent_start", F.lit("clash"))
    assert rows(S.split_sentences(df, "doc_id", "text")) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert S.split_sentences(df.limit(0), "doc_id", "text").count() == 0
