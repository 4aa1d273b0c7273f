"""Secret scan with multipart credential linking.

Base patterns report on their own. Weaker parts (an account identifier, an
opaque token, an endpoint) are everywhere in clean text, so they report only
where complementary parts stand close by in the same scope, a paragraph or the
one beside it: identifiers and secrets need each other, an endpoint needs both.
An interval join finds the partners: a part stands in every bucket that its
interval, widened by ``reach`` code points, meets; equi-join on (document,
bucket), then compare the intervals. So a part only meets parts within reach of
its bucket, however many a document has. Every weak span that reports names the
nearest partner of each role it needs.

One pass reads the texts and keeps only lengths of matches and of what lies
between them; everything after that is on those small rows, and documents
without any match skip it. Only DataFrame functions are used.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import full_text, let, materialize

# The kinds in listed order, their patterns and least lengths.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,  # its second group has 8 characters or more
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "account": r"""(?:[Cc][Ll][Ii][Ee][Nn][Tt]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn])(?:_?(?:[Ii][Dd]|[Nn][Aa][Mm][Ee]))?["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "opaque": r"[A-Za-z0-9+/_-]{20,}={0,2}",
    "endpoint": r"(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?",
    "break": r"\n[\x20\t\r]*\n",
}
KINDS = list(PATTERNS)
BASE = ("assign", "access", "hex")
ROLES = {"id": ("access", "account"), "secret": ("assign", "hex", "opaque")}
NEEDS = {"account": ("secret",), "opaque": ("id",), "endpoint": ("id", "secret")}
SCOPE_GAP = 1
LEAST = {"assign": 8}
REACH = 300


def _matches(text: Column, kind: str) -> Column:
    """array<struct<gap, len, ok>>: leftmost matches and the lengths before each, null if none."""
    pattern = PATTERNS[kind]
    ok = lambda m: F.lit(True)
    if kind in LEAST:
        ok = lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= LEAST[kind]
    elif kind == "opaque":  # a digit and a letter; that an identifier is near decides the rest
        ok = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    pair = lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), ok(m).alias("ok"))
    found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.when(m.isNotNull(), pair(gap, m)))
    return F.when(text.rlike(pattern), F.array_compact(found))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, found): one row per input row; found is null without a match."""
    text = full_text(text_col)
    parts = [F.struct(F.lit(i).alias("kind"), _matches(F.col("text"), k).alias("ms")) for i, k in enumerate(KINDS) if k != "break"]
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    found = F.filter(F.array(*parts), lambda x: x["ms"].isNotNull())
    breaks = F.struct(F.lit(KINDS.index("break")).alias("kind"), _matches(F.col("text"), "break").alias("ms"))
    with_breaks = let(found, lambda f: F.when(F.size(f) > 0, F.concat(f, F.array(breaks))))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", with_breaks.alias("found"))


def scoped_spans(found: DataFrame) -> DataFrame:
    """Rows uid, kind, name, start, end, base, scope: base spans and the weak ones that none covers wholly."""
    each = found.filter("found is not null").select("uid", F.explode("found").alias("f"))
    each = each.select("uid", "f.kind", F.posexplode("f.ms").alias("i", "m")).select("uid", "kind", "i", "m.*")
    before = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(before)
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).filter("ok").select("uid", "kind", "start", "end")

    names = F.array(*[F.lit(k) for k in KINDS])
    spans = spans.withColumn("name", F.get(names, F.col("kind"))).withColumn("base", F.col("name").isin(*BASE))
    past = Window.partitionBy("uid").orderBy("start", F.desc("base"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.select("*", F.count_if(F.col("name") == "break").over(past).alias("scope"), F.max(F.when(F.col("base"), F.col("end"))).over(past).alias("covered"))
    return spans.filter("name <> 'break' and (base or covered is null or covered < end)").drop("covered")


def linked_spans(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Rows uid, kind, name, start, end, base, link of all base spans and of the linked weak ones.

    ``link`` names the partners, "account:4:16+hex:30:62"; null for base spans.
    """
    spans = materialize(scoped_spans(found))
    width = 2 * reach
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    role = F.expr("case " + " ".join(f"when name in ({', '.join(map(repr, kinds))}) then '{r}'" for r, kinds in ROLES.items()) + " end")
    part = spans.withColumn("role", role).filter("role is not null").select(
        "uid", buckets(F.col("start") - reach, F.col("end") + reach).alias("bucket"), F.col("scope").alias("p_scope"), "role", F.col("name").alias("p_name"), F.col("start").alias("p_start"), F.col("end").alias("p_end")
    )
    weak = spans.filter("not base").withColumn("bucket", buckets(F.col("start"), F.col("end")))
    apart = F.greatest(F.col("p_start") - F.col("end"), F.col("start") - F.col("p_end"))
    needed = functools.reduce(lambda a, b: a | b, [(F.col("name") == w) & F.col("role").isin(*roles) for w, roles in NEEDS.items()])
    # an endpoint may hold its partners; identifiers and secrets stand beside each other
    met = weak.join(part, ["uid", "bucket"]).filter(needed & (apart <= reach) & ((apart >= 0) | (F.col("name") == "endpoint")) & (F.abs(F.col("scope") - F.col("p_scope")) <= SCOPE_GAP))
    nearest = F.min(F.struct(F.greatest(apart, F.lit(0)).alias("apart"), "p_start", "p_name", "p_end"))
    roles = met.groupBy("uid", "kind", "name", "start", "end", "role").agg(nearest.alias("p"))
    partner = F.struct("role", F.concat_ws(":", "p.p_name", "p.p_start", "p.p_end").alias("s"))
    linked = roles.groupBy("uid", "kind", "name", "start", "end").agg(F.sort_array(F.collect_list(partner)).alias("partners"))
    whole = F.size("partners") == F.element_at(F.create_map(*[F.lit(x) for w, r in NEEDS.items() for x in (w, len(r))]), F.col("name"))
    linked = linked.filter(whole).select("uid", "kind", "name", "start", "end", F.lit(False).alias("base"), F.array_join(F.transform("partners", lambda x: x["s"]), "+").alias("link"))
    return spans.filter("base").select("uid", "kind", "name", "start", "end", "base", F.lit(None).cast("string").alias("link")).unionByName(linked)


def secret_scan(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of base spans, base_sha256, all spans, links.

    ``links`` has the weak spans with their partners, "opaque:20:42=account:4:16".

    Defined cases: a null or empty text has no spans, so counts of 0, the hash
    of the empty string and empty spans; positions are code points, end
    exclusive; a weak part that a base span covers wholly is not reported again;
    repeated rows each get their result; an empty table gives
    an empty result; further columns are ignored.
    """
    found = materialize(find_spans(docs, id_col, text_col))
    spans = linked_spans(found, reach)
    item = F.struct("start", "kind", F.concat_ws(":", "name", "start", "end").alias("s"))
    link = F.struct("start", "kind", F.concat(F.concat_ws(":", "name", "start", "end"), F.lit("="), "link").alias("s"))
    count = lambda k: F.count_if(F.col("name") == k).alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["s"]), ",")
    per_doc = spans.groupBy("uid").agg(*[count(k) for k in BASE], joined(F.collect_list(F.when(F.col("base"), item))).alias("base_spans"), joined(F.collect_list(item)).alias("spans"), joined(F.collect_list(F.when(F.col("link").isNotNull(), link))).alias("links"))
    some = found.filter("found is not null").select("uid", "doc_id").join(per_doc, "uid", "left").drop("uid")
    none = found.filter("found is null").select("doc_id", *[F.lit(None).cast("long").alias(f"n_{k}") for k in BASE], *[F.lit(None).cast("string").alias(c) for c in ("base_spans", "spans", "links")])
    return some.unionByName(none).select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("links", F.lit("")).alias("links"),
    )
