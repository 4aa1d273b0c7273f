"""Line dedup: range-partitioned line hashes, per-document keep bitmaps.

A line is its 128-bit hash, its document and its position. The hashes are
range-partitioned with document and position as secondary sort, so one ordered
pass sees each key's occurrences side by side and marks the first one in every
document. The result is one run-length bitmap of kept lines per document that
loses a line. Where those bitmaps meet texts, a hashed bit table of their
documents (a few bits each, of bounded size) lets all others pass where they
are: only texts that lose lines, and a few percent of the rest, shuffle.

A key that a third of all documents share is cut into ``salts`` ranges.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import SPACES, ascii_lower, full_text, join_hot_cold, let, materialize


#: Most bits of the table of documents that lose lines (32 MB).
MAX_BITS = 1 << 28


def line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def marked_lines(docs: DataFrame, salts: int = 64) -> DataFrame:
    """Sorted rows h1, h2, salt, doc_id, th, pos, n_lines, first (in its document)."""
    keys = F.transform(line_array(ascii_lower(F.col("text"))), lambda x: F.btrim(x, F.lit(SPACES)))
    split = docs.select("doc_id", "th", keys.alias("keys"))
    lines = split.select("doc_id", "th", F.size("keys").alias("n_lines"), F.posexplode("keys").alias("pos", "key")).filter("key <> ''")
    lines = lines.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.expr(f"pmod(hash(doc_id, th), {salts})").alias("salt"), "doc_id", "th", "pos", "n_lines"
    )
    lines = materialize(lines)  # the range bounds are sampled from here, not from the texts
    lines = lines.repartitionByRange("h1", "h2", "salt")
    w = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "th", "pos")
    return lines.withColumn("first", ~F.lag(F.struct("doc_id", "th")).over(w).eqNullSafe(F.struct("doc_id", "th")))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """Rows doc_id, th, n_dropped, keep: runs (first line, lines) that stay.

    ``docs`` has doc_id, th (hash of the text), text. Lines whose key is in
    ``min_docs`` documents or more go everywhere; with ``keep_first``, each
    key's first occurrence stays. Documents that lose nothing have no row.
    """
    lines = materialize(marked_lines(docs))
    keys = lines.groupBy("h1", "h2").agg(F.count_if("first").alias("n_docs"), F.count("*").alias("n_rows"), F.min(F.struct("doc_id", "th", "pos")).alias("origin"))
    keys = keys.filter(F.col("n_docs") >= min_docs)
    keys = materialize(keys if keep_first else keys.drop("origin"))
    gone = join_hot_cold(lines, keys, ["h1", "h2"], "n_rows", lines.count())
    if keep_first:
        gone = gone.filter(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("origin")))
    gone = gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("d"), F.max("n_lines").alias("n"))
    m = F.size("d")

    def gap(i):
        begin = F.when(i == 0, 0).otherwise(F.get("d", i - 1) + 1)
        return F.struct(begin.alias("first"), (F.coalesce(F.get("d", i), F.col("n")) - begin).alias("lines"))

    runs = F.filter(F.transform(F.sequence(F.lit(0), m), gap), lambda r: r["lines"] > 0)
    return gone.select("doc_id", "th", m.cast("long").alias("n_dropped"), runs.alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The text's kept lines; a null ``keep`` keeps all."""

    def cut(lines):
        return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["first"] + 1, r["lines"]))), "\n")

    return F.when(keep.isNull(), text).otherwise(let(line_array(text), cut))


def listed(rows: DataFrame, maps: DataFrame, n: int) -> DataFrame:
    """Adds ``maybe``: false only where no row of ``maps`` (n rows) has the row's doc_id and th.

    A table of 8 to 16 bits a row of ``maps``, at most MAX_BITS, is broadcast in
    pieces of 4 KB. Beyond that size more rows pass for listed; none is missed.
    """
    size = min(MAX_BITS, 1 << max(15, (8 * max(n, 1) - 1).bit_length()))
    at = lambda: F.pmod(F.xxhash64("doc_id", "th"), F.lit(size))
    bits = maps.select(at().alias("at")).groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    rows = rows.withColumn("at", at()).withColumn("piece", F.bitmap_bucket_number("at")).join(F.broadcast(bits), "piece", "left")
    octet = F.conv(F.hex(F.substring("bits", (F.bitmap_bit_position("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (F.bitmap_bit_position("at") % 8 + 1).cast("int"))
    return rows.withColumn("maybe", F.coalesce(octet.bitwiseAND(bit) != 0, F.lit(False))).drop("at", "piece", "bits")


def with_bitmaps(rows: DataFrame, text: Column, min_docs: int, keep_first: bool = False) -> DataFrame:
    """``rows`` (doc_id and more) with n_dropped and keep, null where nothing goes; ``text`` reads a row's text."""
    rows = rows.withColumn("th", F.xxhash64(text))
    maps = materialize(keep_bitmaps(rows.select("doc_id", "th", text.alias("text")), min_docs, keep_first))
    marked = listed(rows, maps, maps.count())
    maps = maps.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "n_dropped", "keep")
    lose, stay = marked.filter("maybe"), marked.filter("not maybe")
    met = lose.join(maps, lose["doc_id"].eqNullSafe(maps["d2"]) & (lose["th"] == maps["t2"]), "left").drop("d2", "t2")
    return met.unionByName(stay, allowMissingColumns=True).drop("maybe", "th")


def line_dedup(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256, keep.

    A line's key is the line without white space at its ends, A-Z lower-cased;
    ``keep`` is the bitmap of kept lines as runs "first line:lines". Defined cases: a null or empty text is one empty line, which has no key
    and stays; a text that loses every line becomes empty; rows that repeat with
    the same id and text count as one document and each get its result (a null
    id is an id like any other; rows of one id with other texts are documents
    of their own); an empty table gives an empty result; further columns are
    ignored.
    """
    runs = F.array_join(F.transform("keep", lambda r: F.concat_ws(":", r["first"], r["lines"])), ",")
    rows = with_bitmaps(docs.select(F.col(id_col).alias("doc_id"), full_text(text_col).alias("text")), F.col("text"), min_docs)
    return rows.select(
        "doc_id",
        F.size(line_array(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"),
        F.when(F.col("keep").isNull(), F.concat(F.lit("0:"), F.size(line_array(F.col("text"))))).otherwise(runs).alias("keep"),
    )


def deduped_documents(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """``docs`` with the repeated lines taken out of its texts."""
    held = docs.select(F.col(id_col).alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row")[text_col]
    rows = with_bitmaps(held, full_text(text), min_docs, keep_first)
    clean = F.when(F.col("keep").isNull(), text).otherwise(kept_text(text, F.col("keep")))
    return rows.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key)),
g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m WHERE NOT gone),
r AS (SELECT doc_id, min(pos) - 1 AS first, count(*) AS lines FROM g GROUP BY doc_id, run),
b AS (SELECT doc_id, string_agg(first || ':' || lines, ',' ORDER BY first) AS keep FROM r GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
      FROM m GROUP BY doc_id)
SELECT t.*, coalesce(b.keep, '') AS keep FROM t LEFT JOIN b USING (doc_id)
"""
