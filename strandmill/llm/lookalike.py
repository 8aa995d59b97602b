"""Text that looks the same in one form: the skeleton of a text by a table of look-alikes.

Decompose, replace every character by the prototype of its look-alikes, decompose again. Two texts look the same when
their skeletons are equal. Folded are width, kind of blank or hyphen, invisible characters, composition of accents,
ligatures, and letters borrowed from another script or block. Kept are letter case, accents, super- and subscripts, and
every ordinary character, so blanks are neither merged nor cut off.
"""

from __future__ import annotations

import os
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from strandmill.operators.skew import salted_join
from strandmill.session import settle

# Letters that look like a letter of another script or block, each pair as look-alike and prototype.
_LETTERS = """
аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv ԍG ѡw
АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ УY Ԁd ԌG ԚQ ԜW ӀI Ѵv Ѡw
οo νv ιi ρp υu ϲc ϳj
ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ
гr ГΓ ПΠ пπ ФΦ фφ кκ ĸκ ʙв ʜн ᴍм ᴛт ᴙя
ɑα ꭤα ꞵβ ßβ ɣγ ẟδ ɛε ɩi ϕφ ɸφ ʋu ᴨπ ɷω ꭓχ
ıi ȷj ɡg ꜱs ᴏo ᴄc ᴠv ᴡw ᴢz ꞮI ƖI ǀl
օo ոn սu հh ցg զq յj լl ՕO ՍU ՏS
ⲟo ⲞO ⲣp ⲢP ⲥc ⲤC ⲭx
ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU
ⲀA ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲦT ⲨY ⲬX ⲁα ⲅг ⲕκ
ᑭP ᗅA ᖇR ᗞD ᒍJ ᒪL ᑌU ᐯV ᕼH ᗷB ᙭X ᑯd
ƄЬ ℮e
ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ
"""
# Marks that look like a mark of ASCII.
_MARKS = "‘' ’' ʼ' ʹ' ′' ‛' “\" ”\" ‟\" ″\" ∶: ։: ׃: ⁄/ ∕/ −- ⁃- ‚, ∗* ∣| ‐- ‑- ‒- –- ˗- 〜~ ∼~ ‧· ∙· ⋅· ・· ᛫·"
PROTOTYPES: dict[str, str] = {pair[0]: pair[1] for pair in (_LETTERS + _MARKS).split()}
#: Small letters of Cherokee are drawn as small capitals, so those whose Latin twin looks the same in both cases look like its small letter.
PROTOTYPES |= {c.lower(): p.lower() for c, p in PROTOTYPES.items() if "Ꭰ" <= c <= "Ᏼ" and p in "CSVWZ"}
#: Scripts whose digit zero is a plain ring.
_RINGS = ("DEVANAGARI", "GUJARATI", "GURMUKHI", "TELUGU", "KANNADA", "MALAYALAM", "THAI", "LAO", "MYANMAR", "TAMIL", "KHMER")


def read_confusables(path: str) -> dict[str, str]:
    """Look-alikes of a file in the form of the public Unicode table (``source ; target ; type # comment``, code points in hex).

    Sources of several characters and pairs within ASCII are left out: letters and digits of ASCII stay different here.
    """
    out: dict[str, str] = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [p.strip() for p in line.split("#")[0].split(";")]
            if len(parts) >= 2 and parts[0] and " " not in parts[0]:
                a, b = chr(int(parts[0], 16)), "".join(chr(int(x, 16)) for x in parts[1].split())
                if not (a.isascii() and a.isprintable()):
                    out[a] = b
    return out


if os.environ.get("STRANDMILL_CONFUSABLES"):
    PROTOTYPES = read_confusables(os.environ["STRANDMILL_CONFUSABLES"]) | PROTOTYPES
#: Compatibility decompositions that keep the look; super- and subscripts, fractions and circles change it.
_SAME_LOOK = ("<wide>", "<narrow>", "<small>", "<font>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
_INVISIBLE = frozenset("͏ᅟᅠ឴឵ㅤﾠ")


def _fold(ch: str, depth: int = 0) -> str:
    """The prototype of one character: '' if it can't be seen, a blank for every kind of blank."""
    cat = unicodedata.category(ch)
    if cat == "Cf" or ch in _INVISIBLE or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or (cat == "Cc" and ch not in "\t\n\v\f\r\x85"):
        return ""
    if cat in ("Zs", "Zl", "Zp") or cat == "Cc":
        return " "
    if ch in PROTOTYPES:
        target = PROTOTYPES[ch]
        return target if len(target) == 1 and target not in PROTOTYPES or depth > 8 else "".join(_fold(c, depth + 1) for c in target)
    if cat == "Nd" and unicodedata.decimal(ch) == 0 and unicodedata.name(ch, "").startswith(_RINGS):
        return "o"
    parts = unicodedata.decomposition(ch).split()
    if not parts or depth > 8 or (parts[0][0] == "<" and parts[0] not in _SAME_LOOK):
        return ch
    return "".join(_fold(chr(int(p, 16)), depth + 1) for p in parts if p[0] != "<")


class _Table(dict):
    """Filled as characters are met: at most one entry for each character of Unicode."""

    def __missing__(self, code: int) -> str:
        self[code] = out = _fold(chr(code))
        return out


_TABLE = _Table()


def skeleton(text: str | None) -> str | None:
    """The form in which equal-looking texts are equal; null stays null, a text of invisible characters becomes empty."""
    if text is None:
        return None
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_TABLE))


@pandas_udf(StringType())
def skeleton_of(names: pd.Series) -> pd.Series:
    return names.map(skeleton, na_action="ignore").astype(object)


def with_skeleton(df: DataFrame, column: str, out: str = "skeleton") -> DataFrame:
    return df.withColumn(out, skeleton_of(F.col(column)))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def twin_classes(names: DataFrame) -> DataFrame:
    """``id, form, class_id, n_spellings, n_ids``: each id of ``names(id, name)`` whose name has a twin, with its class.

    A class are all ids whose names look the same, of at least two spellings; ``class_id`` is its smallest id. An id
    with several names of different looks is in several classes. One row per id and class, whatever the size of a class:
    pairs are never made, and sums and minima are partial before they are shuffled.
    """
    rows = names.select(_text("id").alias("id"), _text("name").alias("name")).where("id is not null and name is not null").distinct()
    formed = with_skeleton(rows, "name", "form").where("form <> ''")
    classes = formed.groupBy("form").agg(F.min("id").alias("class_id"), F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b").select("form", "class_id")
    kept = salted_join(formed, classes, "form", "inner", F.col("id"))
    spellings = kept.select("form", "name").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("n_spellings"))
    ids = kept.select("form", "id").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("n_ids"))
    sizes = spellings.join(ids, "form")
    return salted_join(kept.select("id", "form", "class_id").distinct(), sizes, "form", "inner", F.col("id")).select("id", "form", "class_id", "n_spellings", "n_ids")


def twins_within(names: DataFrame) -> DataFrame:
    """``row_key, node_id``: pairs of different ids of ``names(id, name)`` whose names look the same and differ; the smaller id first.

    The pairs are the result asked for; ``twin_classes`` gives the same links as classes. Spellings are grouped by
    skeleton first, and only skeletons with several spellings go on, so that any number of exact copies of a name costs
    nothing; ids are then joined to the pairs of spellings. Skeletons, and spellings of many ids, that hold a great
    share are spread over tasks. Null names and names without a visible character have no twins; repeated rows count once.
    """
    rows = names.select(_text("id").alias("id"), _text("name").alias("name")).where("id is not null and name is not null").distinct()
    spellings = with_skeleton(rows.select("name").distinct(), "name").where("skeleton <> ''")
    several = spellings.groupBy("skeleton").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b").select("skeleton")
    kept = settle(spellings.join(several, "skeleton", "left_semi"), "spellings")
    pairs = salted_join(kept.select("skeleton", F.col("name").alias("a")), kept.select("skeleton", F.col("name").alias("b")), "skeleton", "inner", F.col("a")).where("a < b").select("a", "b")
    some = settle(salted_join(rows, kept.select("name"), "name", "left_semi", F.col("id")), "twin-ids")
    first = salted_join(some.select(F.col("name").alias("a"), F.col("id").alias("ia")), pairs, "a", "inner", F.col("ia"))
    found = salted_join(first, some.select(F.col("name").alias("b"), F.col("id").alias("ib")), "b", "inner", F.col("ia")).where("ia <> ib")
    return found.select(F.least("ia", "ib").alias("row_key"), F.greatest("ia", "ib").alias("node_id")).distinct()


def twins_by_name(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``row_key, node_id``: rows ``(row_key, name)`` and nodes ``(id, name)`` whose names look the same and differ. A name that many rows share is spread over tasks."""
    left = with_skeleton(rows.select(_text("row_key").alias("row_key"), _text("name").alias("name")).where("name is not null"), "name").where("skeleton <> ''")
    right = with_skeleton(nodes.select(_text("id").alias("node_id"), _text("name").alias("node_name")).where("name is not null").distinct(), "node_name").where("skeleton <> ''")
    joined = salted_join(left, right, "skeleton", "inner", F.col("row_key"))
    return joined.where("name <> node_name").select("row_key", "node_id").distinct()


def twins_by_id(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``row_key, node_id``: rows ``(row_key, id, name)`` whose name looks like that of the node they cite and differs from it.

    A node that many rows cite is spread over tasks; skeletons are made of the differing names only.
    """
    left = rows.select(_text("row_key").alias("row_key"), _text("id").alias("id"), _text("name").alias("name")).where("id is not null and name is not null")
    right = nodes.select(_text("id").alias("id"), _text("name").alias("node_name")).where("name is not null").distinct()
    joined = salted_join(left, right, "id", "inner", F.col("row_key")).where("name <> node_name")
    both = joined.withColumn("a", skeleton_of("name")).withColumn("b", skeleton_of("node_name"))
    return both.where("a = b and a <> ''").select("row_key", F.col("id").alias("node_id")).distinct()
