"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the matches of fixed formats (e-mail, address, card, phone). Every seed and every other
identifier-like run of a text is an instance; the word before it, that word with its shape, and the words on
both sides are its patterns. Instances and patterns form a graph: a pattern's confidence for a kind is the
share of that kind among its instances (unexplained ones count half), an instance's is the noisy-or of its patterns' confidences,
and accepted instances are seeds of the next round, until a round accepts nothing new. Instances of
high-confidence patterns become further spans; those of the fixed formats always stay.

Positions are code points. Splitting a text by a format and extracting the same format's matches
gives the lengths between, and a running sum over them the positions, without leaving the JVM.

Nulls: a null text is empty and has no spans; a null id is a document of its own. Repeated rows give
equal results and count as one document for support if their ids are equal. Ties of two kinds for one
pattern or value go to the later name. Very long texts are searched whole and in linear time but for
sorting their matches. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: The fixed formats; possessive repeats and looking behind (or at the last match's end) change no match, but keep scans linear.
FORMATS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier without having a fixed format: groups of digits with blanks, brackets, points or dashes
#: between, or a run of letters, digits and marks with a digit or @ in it (no kind of identifier goes without one).
TOKEN = r"(?:(?<![A-Za-z0-9@._%+-])|\G)(?:\(?[0-9]++(?:[\x20().-]{1,2}+[0-9]++)++|(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]++)"
#: Code points around an instance in which its neighbour words are looked for; a longer word counts by its nearer end.
AROUND = 80
#: A pattern needs the support of so many documents; an instance is accepted from CONFIDENT on, by patterns from LEAST_PATTERN on.
LEAST_DOCS, CONFIDENT, LEAST_PATTERN = 5, 0.9, 0.7
#: What an instance that no seed explains counts in a pattern's share; a seed of another kind counts as one.
UNEXPLAINED = 0.5

_MATCH = "struct<kind:string,place:int,gap:int,value:string,before:string,after:string>"


def found(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<kind, place, gap, value, before, after>> of all matches in order; gap: code points since the last match."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(hits.alias("h"), F.slice(gaps, 1, F.size(hits)).alias("b"), F.slice(gaps, 2, F.size(hits)).alias("a"))
    each = F.transform(
        zipped,
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.length(x["b"]).alias("gap"), x["h"].alias("value"), F.right(x["b"], F.lit(AROUND)).alias("before"), F.left(x["a"], F.lit(AROUND)).alias("after")),
    )
    return F.when(F.size(hits) > 0, each).otherwise(F.array().cast(f"array<{_MATCH}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(span: Column) -> Column:
    digits = _digits(span["value"])
    parts = F.transform(F.split(span["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return (
        F.when(span["kind"] == "ip", F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).try_cast("int") <= 255)))
        .when(span["kind"] == "card", F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
        .when(span["kind"] == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _patterns(span: Column) -> Column:
    """Lexical patterns of an instance: the word before, that word with the instance's shape, and the words on both sides."""
    flat = lambda c: F.lower(F.translate(c, "\t\n\x0b\x0c\r", "     "))
    left = F.substring_index(F.rtrim(flat(span["before"])), " ", -1)
    right = F.substring_index(F.ltrim(flat(span["after"])), " ", 1)
    shape = F.regexp_replace(F.regexp_replace(span["value"], "[0-9]+", "9"), "[A-Za-z]+", "a")
    return F.array(F.concat_ws("\x01", F.lit("l"), left), F.concat_ws("\x01", F.lit("b"), left, shape), F.concat_ws("\x01", F.lit("m"), left, right))


def matches_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, matches of all formats and of TOKEN: rows with any digit or @ alone."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(text.rlike("[0-9@]"))
    need = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    none = F.array().cast(f"array<{_MATCH}>")
    every = F.concat(*[F.when(need[k], found(text, FORMATS[k], k)).otherwise(none) for k in KINDS], found(text, TOKEN, "other"))
    return common.materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", every.alias("matches")), "pii-matches")


def spans_of(matches: DataFrame) -> DataFrame:
    """uid, doc_id, kind, start, stop, value, before, after: valid spans of the fixed formats, and as kind `other` what TOKEN finds outside of them."""
    one = matches.select("uid", "doc_id", F.explode("matches").alias("m")).select("uid", "doc_id", "m.*")
    size = F.length("value")
    upto = Window.partitionBy("uid", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("stop", F.sum(F.col("gap") + size).over(upto).cast("int")).withColumn("start", F.col("stop") - size)
    one = one.where(valid(F.struct("kind", "value"))).drop("gap", "place")
    fixed = F.col("kind") != "other"
    ahead = Window.partitionBy("uid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("uid").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    one = one.withColumns({"last": F.max(F.when(fixed, F.col("stop"))).over(ahead), "next": F.min(F.when(fixed, F.col("start"))).over(behind)})
    free = (F.coalesce("last", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("next") >= F.col("stop"), F.lit(True))
    return common.materialize(one.where(fixed | free).drop("last", "next"), "pii-spans")


def discover(spans: DataFrame, least_docs: int = LEAST_DOCS, confident: float = CONFIDENT) -> DataFrame:
    """uid, start, stop, kind of further spans: instances whose patterns and values are confident."""
    other = F.col("kind") == "other"
    document = F.coalesce("doc_id", -1 - F.col("uid"))
    edges = spans.select(document.alias("doc"), "kind", "value", F.explode(_patterns(F.struct("value", "before", "after"))).alias("pattern"))
    # one edge between an instance and a pattern counts once a document
    graph = common.materialize(edges.groupBy("pattern", "value", "kind").agg(F.count_distinct("doc").alias("docs")), "pii-graph")
    open_, known = graph.where(other).drop("kind"), graph.where(~other).withColumn("belief", F.lit(1.0))
    of_pattern = common.materialize(graph.groupBy("pattern").agg(F.sum(F.col("docs") * F.when(other, UNEXPLAINED).otherwise(1.0)).alias("all_docs"), F.count_if(other).alias("values")).where("values > 0"), "pii-patterns")
    total = open_.count()
    new, before = None, 0
    while True:
        voters = known
        if new is not None:
            voters = known.unionByName(open_.join(common.broadcast_if_small(new, before), "value").select("pattern", "value", "kind", "docs", "belief"))
        scored = voters.groupBy("pattern", "kind").agg(F.sum(F.col("docs") * F.col("belief")).alias("mass"), F.sum("docs").alias("support"))
        scored = scored.join(of_pattern, "pattern").withColumn("confidence", F.col("mass") / (F.col("all_docs") + 0.1))
        scored = scored.where((F.col("support") >= least_docs) & (F.col("confidence") >= LEAST_PATTERN))
        best = F.max(F.struct(F.least("confidence", F.lit(1.0)).alias("confidence"), "kind")).alias("b")
        scored = common.materialize(scored.groupBy("pattern", "values").agg(best).select("pattern", "values", "b.kind", "b.confidence"), "pii-scored")
        votes = common.join_groups(open_.select("pattern", "value"), scored, "pattern", "values", total).where("kind is not null").groupBy("value", "kind")
        votes = votes.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("belief"))
        new = common.materialize(votes.groupBy("value").agg(F.max(F.struct("belief", "kind")).alias("b")).select("value", "b.kind", "b.belief").where(F.col("belief") >= confident), "pii-believed")
        n = new.count()
        if n <= before:  # more seeds never lower a confidence, so as many are the same ones
            break
        before = n
    return spans.where(other).drop("kind").join(common.broadcast_if_small(new, n), "value").select("uid", "start", "stop", "kind")


def personal_data(docs: DataFrame, **cols: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per input row."""
    matches = matches_of(docs, **cols)
    spans = spans_of(matches)
    every = spans.where("kind != 'other'").select("uid", "start", "stop", "kind", F.lit(True).alias("base"))
    every = every.unionByName(discover(spans).withColumn("base", F.lit(False)))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct(rank.alias("rank"), "start", "stop", "kind")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    by_row = every.groupBy("uid").agg(
        F.array_sort(F.collect_list(item)).alias("all"), F.array_sort(F.collect_list(F.when(F.col("base"), item))).alias("fixed"),
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS], F.count_if(~F.col("base")).alias("n_added"),
    )
    counts = [f"n_{k}" for k in KINDS]
    some = matches.select("uid", "doc_id").join(by_row, "uid", "left")
    some = some.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.sha2(F.coalesce(joined(F.col("fixed")), F.lit("")), 256).alias("base_sha256"), F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"), F.coalesce("n_added", F.lit(0).cast("long")).alias("n_added"))
    text, key = cols.get("text_col", "text"), cols.get("id_col", "doc_id")
    zero = F.lit(0).cast("long")
    rest = docs.where(~F.coalesce(F.col(text), F.lit("")).rlike("[0-9@]")).select(F.col(key).cast("long").alias("doc_id"), *[zero.alias(c) for c in counts], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_added"))
    return some.unionByName(rest)
