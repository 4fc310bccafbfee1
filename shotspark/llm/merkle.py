"""Document fingerprints: a Merkle tree over paragraphs and sections, with column functions only.

Paragraphs are the lines of a text. A section ends behind a paragraph whose digest says so (one in
four), so sections find back to each other behind an edit. Paragraph digests are SHA-256 of the
text, section digests of their paragraphs' digests, the root of the sections' digests. Below the
paragraphs, spans of up to eight words get short codes that locate edits inside a paragraph.

A fingerprint keeps the whole tree: the root and a colon, then the sections, each ended by a bar. A
section is the head of its digest, a slash and its paragraphs, each ended by a comma; a paragraph is the
head of its digest, a full stop and the codes of its spans. Equal texts have equal roots and
fingerprints.

Two trees are compared from the top. Equal roots end it. Sections whose digest the other tree has are
the same branch and are not entered; of the others, paragraphs whose digest stands in an open
section of the other tree are the same; only in the paragraphs that are left are codes compared.
``likeness`` is the share of the spans, of both texts, that stand in equal branches or have equal
codes (what repeats counts once); ``differing`` gives the paragraphs that are left, which is where the texts were edited.

Cases: a null text is empty; an empty text has one empty paragraph; rows that share a key are
ordered by a hash of their text; a null key comes first; the next document of the last is the
first, of a single one itself; an empty table gives an empty result. Only key and text are read,
so further columns cannot clash. Texts of any length are one row; a branch is entered only where it
differs. Keys identify documents and are numbers: very many rows with one key meet in one slice (sorted
there on disk, never held in memory).
"""

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.llm.common import table

MAX_SLICES = 1 << 16
SLICE_CHARS = 4_000_000  # text in a slice of neighbouring documents, on average
SPAN = r"\s*+(?:\S{1,40}+\s*+){1,8}+|\s++"  # covers all characters, so codes leave no gap
HEAD = 16  # characters of a digest that a fingerprint keeps for sections and paragraphs
CODE = 8  # characters of the code of a span


def _codes(paragraph) -> F.Column:
    spans = F.regexp_extract_all(paragraph, F.lit(SPAN), F.lit(0))
    return F.array_join(F.transform(spans, lambda s: F.lower(F.lpad(F.hex(F.crc32(s.cast("binary"))), CODE, "0"))), "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of the column ``text`` (never null) as the column ``name``."""
    nodes = F.transform(
        F.split(text, "\n"), lambda p: F.struct(F.sha2(p.cast("binary"), 256).alias("digest"), _codes(p).alias("codes"))
    )
    # a paragraph's line ends with a mark, which is a bar behind the last one of a section
    lines = F.transform(
        nodes,
        lambda n: F.concat(n["digest"], F.lit("."), n["codes"], F.when(F.crc32(n["digest"].cast("binary")) % 4 == 0, "|").otherwise(",")),
    )
    sections = F.filter(F.split(F.array_join("_lines", ""), r"\|"), lambda s: s != "")
    digests = F.transform("_sections", lambda s: F.sha2(F.regexp_replace(s, r"\.[0-9a-f]*", "").cast("binary"), 256))
    root = F.sha2(F.array_join("_digests", "").cast("binary"), 256)
    short = F.transform(
        "_sections",
        lambda s, i: F.concat(
            F.substring(F.get("_digests", i), 1, HEAD), F.lit("/"),
            F.regexp_replace(F.rtrim(s, F.lit(",")), rf"([0-9a-f]{{{HEAD}}})[0-9a-f]{{{64 - HEAD}}}\.", "$1."),
        ),
    )
    out = df.withColumn("_lines", lines).withColumn("_sections", sections).withColumn("_digests", digests)
    return out.withColumn(name, F.concat(root, F.lit(":"), F.array_join(short, "|"))).drop("_lines", "_sections", "_digests")


def _sections(mark) -> F.Column:
    return F.split(F.substring_index(mark, ":", -1), r"\|")


def _paragraphs(sections) -> F.Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, "/", -1), ",")))


def _spans(paragraphs) -> F.Column:
    """Codes of the spans of some paragraphs."""
    codes = F.array_join(F.transform(paragraphs, lambda p: F.substring_index(p, ".", -1)), "")
    return F.regexp_extract_all(codes, F.lit(f"[0-9a-f]{{{CODE}}}"), F.lit(0))


def differing(a, b) -> F.Column:
    """Paragraphs of ``a`` (digest, full stop, codes) in no branch that ``b`` has. A branch starts with its digest, so equal
    branches are found, and different ones told apart, by their heads."""
    x, y = _sections(a), _sections(b)
    return F.array_except(_paragraphs(F.array_except(x, y)), _paragraphs(F.array_except(y, x)))


def _let(value, then) -> F.Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def likeness(a, b) -> F.Column:
    """0 to 1 for two fingerprint columns."""

    def share(found):
        same, u, v = found["same"].cast("double"), found["u"], found["v"]
        total = 2 * same + F.size(u) + F.size(v)
        return F.when(total > 0, 2 * (same + F.size(F.array_intersect(u, v))) / total).otherwise(0.0)

    def spans(x):
        p, q = x["p"], x["q"]
        return F.struct(
            (x["same"] + F.size(_spans(F.array_intersect(p, q)))).alias("same"),
            F.array_distinct(_spans(F.array_except(p, q))).alias("u"), F.array_distinct(_spans(F.array_except(q, p))).alias("v"),
        )

    def paragraphs(s):
        x, y = s["x"], s["y"]
        return F.struct(
            F.size(_spans(_paragraphs(F.array_intersect(x, y)))).alias("same"),
            _paragraphs(F.array_except(x, y)).alias("p"), _paragraphs(F.array_except(y, x)).alias("q"),
        )

    sections = F.struct(_sections(a).alias("x"), _sections(b).alias("y"))
    compared = _let(sections, lambda s: _let(paragraphs(s), lambda x: _let(spans(x), share)))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), 1.0).otherwise(compared)


def _place(value, cuts: list) -> F.Column:
    """How many of the ascending ``cuts`` lie below ``value``, found in two steps, so that a row is
    compared with about twice the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def below(numbers):
        return F.size(F.filter(numbers, lambda c: c < value))

    def listed(rows):
        # a text that is taken apart while the query is planned; a list of columns would be a large plan
        return F.split(F.lit("|".join(",".join(map(str, r)) for r in rows)), r"\|")

    heads = F.split(F.lit(",".join(str(g[0]) for g in groups)), ",").cast("array<decimal(38,6)>")
    group = F.greatest(below(heads) - 1, F.lit(0))
    return group * step + below(F.split(F.get(listed(groups), group), ",").cast("array<decimal(38,6)>"))


def with_next(
    docs: DataFrame, columns: list[str], key: str = "doc_id", order: str = "order", chars: str = "n_chars",
    prepare=None, slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """Rows of ``docs`` with a struct ``next`` of ``columns`` of the document behind each in
    ascending order of ``key`` (a number) and ``order``; the first one stands behind the last.
    ``prepare`` adds columns to the rows once they are dealt, so that it sees each row once.

    Rows are dealt once, to slices of neighbouring keys. Each slice also gets the first row of
    the slice behind it, so the window over a slice needs nothing from outside. Beyond
    MAX_SLICES slices get longer; a slice is sorted on disk, so its size is no limit."""
    total, n = docs.agg(F.sum(chars), F.count("*")).first()
    slices = max(1, min(n, math.ceil((total or 0) / slice_chars), MAX_SLICES))
    number = F.lit(0)
    if slices > 1:
        shares = [i / slices for i in range(1, slices)]
        cuts = sorted(set(docs.agg(F.percentile_approx(key, shares, 20 * slices)).first()[0] or []))
        number = _place(F.col(key), cuts)
    placed = docs.withColumn("_slice", F.when(F.col(key).isNull(), 0).otherwise(number).cast("int")).withColumn("_last", F.lit(0))
    lowest = F.min(F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key")))  # nulls come first
    heads = sorted((r["_slice"], r["m"]["key"]) for r in placed.groupBy("_slice").agg(lowest.alias("m")).collect())
    prepare = prepare or (lambda df: df)
    if not heads:
        return prepare(docs).withColumn("next", F.struct(*columns))
    # the first row of each slice stands once more at the end of the slice before it; one row per slice
    marks = docs.sparkSession.createDataFrame(
        [(n, k, before) for (n, k), (before, _) in zip(heads, heads[-1:] + heads[:-1])],
        T.StructType([T.StructField("_at", T.IntegerType()), T.StructField("_head", docs.schema[key].dataType), T.StructField("_before", T.IntegerType())]),
    )
    first = (
        placed.join(F.broadcast(marks), (F.col("_slice") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_head")))
        .groupBy("_before")
        .agg(F.min(F.struct(key, order, F.struct(*docs.columns).alias("row"))).alias("m"))
    )
    copies = first.select("m.row.*", F.col("_before").alias("_slice"), F.lit(1).alias("_last"))
    behind = Window.partitionBy("_slice").orderBy("_last", key, order)
    return (
        prepare(placed.unionByName(copies))
        .withColumn("next", F.lead(F.struct(*columns)).over(behind))
        .filter("_last = 0")
        .drop("_slice", "_last")
    )


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, with their likeness."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    docs = docs.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("order"))
    paired = with_next(docs, ["text", "fingerprint"], prepare=lambda df: with_fingerprint(df, "text", "fingerprint"))
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substr("text", F.lit(1), F.col("n_chars").cast("int") - moved)
    edited = paired.select(
        "doc_id", "n_chars", "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"),
        F.concat(kept, F.substr("next.text", F.lit(1), moved)).alias("edited"),
    )
    return with_fingerprint(edited, "edited", "edited_fingerprint").select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
