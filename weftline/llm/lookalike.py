"""Visually identical text to one form: positioned code points, broadcast mappings, recomposition."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.skew import block_pairs, join_unique
from weftline.session import Scratch

# Letters of other scripts and the Latin letter each looks like.
CYRILLIC_LOWER = "аеіјорсухѕһԁԛԝӏѵү", "aeijopcyxshdqwlvy"
CYRILLIC_UPPER = "АВЕІЈКМНОРСТУХЅԌԚԜӀ", "ABEIJKMHOPCTYXSGQWI"
GREEK_LOWER = "ονιϳϲαρυ", "ovijcapu"
GREEK_UPPER = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"
ARMENIAN = "օոսցՕՍՏ", "onugOUS"
LATIN_OTHER = "ɑɡıƖǀ", "agill"
# Invisible characters that are no format characters.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
# Compatibility forms that read like their parts.
_READ_ALIKE = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


def look_alikes() -> dict[int, int]:
    out: dict[int, int] = {}
    for odd, plain in (CYRILLIC_LOWER, CYRILLIC_UPPER, GREEK_LOWER, GREEK_UPPER, ARMENIAN, LATIN_OTHER):
        out |= {ord(a): ord(b) for a, b in zip(odd, plain, strict=True)}
    return out


@lru_cache(1)
def mapping() -> list[tuple[int, list[int]]]:
    """(code point, decomposed and unified code points) for every code point that does not stand for itself.

    Canonical decompositions; full-width, half-width and font variants, ligatures and Roman
    numerals; any space to the plain one; format characters and variation selectors to nothing;
    look-alike letters to Latin. Superscripts, fractions, circled forms and punctuation stay: they
    do not read the same. Derived from the Unicode database, so its size is fixed (some 5,000).
    """
    like = look_alikes()

    def full(ch: str) -> list[int]:
        cp = ord(ch)
        if cp in like:
            return [like[cp]]
        cat = unicodedata.category(ch)
        if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\r\v\f\x85":
            return [32]
        if cat == "Cf" or ch in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            return []
        if 0xAC00 <= cp <= 0xD7A3:  # Hangul syllables are composed, not taken apart
            return [cp]
        d = unicodedata.decomposition(ch)
        if d:
            tag, *rest = d.split() if d[0] == "<" else ("", *d.split())
            if not tag or tag in _READ_ALIKE or (tag == "<compat>" and cat[0] in "LN"):
                return [x for p in rest for x in full(chr(int(p, 16)))]
        return [cp]

    return [(cp, m) for cp in range(sys.maxunicode + 1) if not 0xD800 <= cp <= 0xDFFF and (m := full(chr(cp))) != [cp]]


@lru_cache(1)
def compositions() -> list[tuple[int, int, int]]:
    """(first, second, composite) for every pair that composes to one character, without Hangul, which is composed by rule; some 950."""
    out = []
    for cp in range(sys.maxunicode + 1):
        p = [] if 0xD800 <= cp <= 0xDFFF else unicodedata.decomposition(chr(cp)).split()
        if len(p) == 2 and p[0][0] != "<":
            a, b = int(p[0], 16), int(p[1], 16)
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(cp):
                out.append((a, b, cp))
    return out


def _joins() -> Column:
    """The pairs that compose, as one constant map from first * 2^21 + second."""
    c = compositions()
    return F.map_from_arrays(F.lit([(a << 21) + b for a, b, _ in c]), F.lit([ab for _, _, ab in c]))


def composed(run: Column) -> Column:
    """Code points of a starter and what stands behind it (struct ccc, cp, in canonical order), composed.

    One fold over any number of marks: a mark joins the starter if a composite exists and no mark
    before it that stayed has its class or a higher one; Hangul vowels and finals join by rule.
    """
    def step(s: Column, x: Column) -> Column:
        base, cp = s["base"], x["cp"]
        vowel = base.between(0x1100, 0x1112) & cp.between(0x1161, 0x1175)
        final = base.between(0xAC00, 0xD7A3) & ((base - 0xAC00) % 28 == 0) & cp.between(0x11A8, 0x11C2)
        pair = F.when(vowel, 0xAC00 + ((base - 0x1100) * 21 + cp - 0x1161) * 28).when(final, base + cp - 0x11A7).otherwise(F.try_element_at(_joins(), F.shiftleft(base.cast("long"), 21) + cp))
        ab = F.when((F.size(s["rest"]) == 0) | (s["last"] < x["ccc"]), pair)
        return F.when(ab.isNotNull(), F.struct(ab.cast("int").alias("base"), s["rest"].alias("rest"), s["last"].alias("last"))).otherwise(
            F.struct(base.alias("base"), F.concat(s["rest"], F.array(cp)).alias("rest"), x["ccc"].alias("last"))
        )

    start = F.struct(F.get(run, 0)["cp"].alias("base"), F.array().cast("array<int>").alias("rest"), F.lit(0).alias("last"))
    whole = F.aggregate(F.slice(run, 2, F.greatest(F.size(run), F.lit(2))), start, step, lambda s: F.concat(F.array(s["base"]), s["rest"]))
    return F.when(F.size(run) == 1, F.transform(run, lambda x: x["cp"])).otherwise(whole)


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decomposition and look-alike map, the same composed to text, combining classes)."""
    m = mapping()
    parts = spark.createDataFrame(m, "cp int, parts array<int>")
    plain = spark.createDataFrame([(cp, unicodedata.normalize("NFC", "".join(map(chr, x)))) for cp, x in m], "cp int, s string")
    ccc = spark.createDataFrame([(cp, c) for cp in range(0x1FFFF) if not 0xD800 <= cp <= 0xDFFF and (c := unicodedata.combining(chr(cp)))], "cp int, ccc int")
    return parts, plain, ccc


def tidy(c: Column | str) -> Column:
    """White space (space, tab, line ends) collapsed and trimmed; nothing else changes."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\v\f]+", " "))


def unify_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(``column``, ``form``): the one visual form of each distinct non-null text.

    Texts of plain ASCII are their own form but for white space: no mapping touches ASCII. All
    others are exploded to positioned code points. The rows of a text stay in the partition that
    its hash names from the explosion to the rebuilt string, so there is one shuffle, of texts.
    Characters that meet no combining mark are mapped one by one; texts with combining marks (or
    conjoining jamo) are taken apart, their marks ordered by class, and recomposed, however many
    marks a letter has. Empty texts give the empty form.
    """
    spark = texts.sparkSession
    parts, plain, ccc = tables(spark)
    t = texts.select(F.col(column).alias("text")).filter("text is not null").distinct()
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7f]")
    done = t.filter(ascii_only).select("text", tidy("text").alias("form"))
    rest = t.filter(~ascii_only).withColumn("tid", F.unhex(F.md5("text"))).repartition("tid")
    marked = F.col("text").rlike(r"[\p{M}ᄀ-ᇿꥠ-꥿ힰ-퟿]")
    exploded = rest.select("tid", marked.alias("marked"), F.posexplode(F.split("text", "")).alias("pos", "ch")).withColumn("cp", F.ascii("ch"))

    easy = exploded.filter("not marked").join(F.broadcast(plain), "cp", "left").select("tid", "pos", F.coalesce("s", "ch").alias("s"))
    easy = _rebuild(easy, "pos")

    hard = exploded.filter("marked").join(F.broadcast(parts), "cp", "left")
    hard = hard.select("tid", "pos", F.posexplode(F.coalesce("parts", F.array("cp"))).alias("sub", "cp")).join(F.broadcast(ccc), "cp", "left")
    order = Window.partitionBy("tid").orderBy("pos", "sub")
    # a run is a starter and all behind it that may join it: marks, and signs of class 0 that are second in a composite
    second = sorted({b for _, b, _ in compositions() if not unicodedata.combining(chr(b))})
    joins = F.col("cp").between(0x1161, 0x1175) | F.col("cp").between(0x11A8, 0x11C2) | F.col("cp").isin(second)
    hard = hard.withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    hard = hard.withColumns({"run": F.sum(F.when((F.col("ccc") == 0) & ~joins, 1).otherwise(0)).over(order), "part": F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(order)})
    runs = hard.groupBy("tid", "run").agg(F.array_sort(F.collect_list(F.struct("part", "ccc", "pos", "sub", "cp"))).alias("m"))
    runs = runs.select("tid", "run", composed(F.transform("m", lambda x: F.struct(x["ccc"].alias("ccc"), x["cp"].alias("cp")))).alias("m"))
    chars = F.transform("m", lambda x: F.decode(F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-32"))
    hard = _rebuild(runs.select("tid", "run", F.array_join(chars, "").alias("s")), "run")

    forms = easy.unionByName(hard)
    built = rest.select("tid", "text").join(forms, "tid", "left").select("text", tidy(F.coalesce("form", F.lit(""))).alias("form"))
    return done.unionByName(built).withColumnRenamed("text", column)


def _rebuild(chars: DataFrame, by: str) -> DataFrame:
    sorted_chars = F.array_sort(F.collect_list(F.struct(by, "s")))
    return chars.groupBy("tid").agg(F.array_join(F.transform(sorted_chars, lambda x: x["s"]), "").alias("form"))


def unified_column(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text, form) of every row; a null text has a null form."""
    forms = unify_texts(df, column).select(F.col(column).alias("text"), "form")
    return join_unique(df.select(key, F.col(column).alias("text")), forms, "text", "left")


def look_alike_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key_a, key_b) of all rows whose texts read the same but differ after plain white space is collapsed."""
    rows = df.select(key, column).filter(f"{key} is not null and {column} is not null").distinct()
    u = unified_column(rows, key, column).select(F.col("form"), F.col(key).alias("k"), tidy("text").alias("plain"))
    u = Scratch(df.sparkSession, "p6").write(u, "forms")
    return block_pairs(u, "form", "k", differ="plain").select(F.col("a").alias("key_a"), F.col("b").alias("key_b"))


def look_alikes_found(works: DataFrame, institutions: DataFrame) -> DataFrame:
    a = look_alike_pairs(works, "work_id", "title").select(F.lit("works.title").alias("field_name"), "key_a", "key_b")
    b = look_alike_pairs(institutions, "institution_id", "display_name").select(F.lit("institutions.display_name").alias("field_name"), "key_a", "key_b")
    return a.unionByName(b)


def unified_names(works: DataFrame, institutions: DataFrame) -> DataFrame:
    """Every title and name in its one form: field_name, key, text, form; repeats of rows taken once."""
    a = unified_column(works.select("work_id", "title").distinct(), "work_id", "title").select(F.lit("works.title").alias("field_name"), F.col("work_id").alias("key"), "text", "form")
    b = unified_column(institutions.select("institution_id", "display_name").distinct(), "institution_id", "display_name").select(F.lit("institutions.display_name").alias("field_name"), F.col("institution_id").alias("key"), "text", "form")
    return a.unionByName(b)
