"""Ontology files as tables: terms(term, label) and edges(parent, child), from OBO text or RDF/XML.

Kept are terms whose name starts with a prefix and which have exactly one label, and edges between
kept terms; a term may have several parents. Files are split by stanza or element, so no task reads a
whole file as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ELEMENT = "`_rdf:about` string, `rdfs:label` array<string>, `rdfs:subClassOf` array<struct<`_rdf:resource`:string>>"


def _kept(raw: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """raw(term, labels, parents): stanzas of one term count as one."""
    named = raw.where(F.col("term").startswith(prefix))
    merged = named.groupBy("term").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"), F.array_distinct(F.flatten(F.collect_list("parents"))).alias("parents"))
    one = merged.where(F.size("labels") == 1)
    terms = one.select("term", F.col("labels")[0].alias("label"))
    edges = one.select(F.explode("parents").alias("parent"), F.col("term").alias("child")).where("parent != child").distinct()
    return terms, edges.join(terms.select(F.col("term").alias("parent")), "parent", "left_semi")


def read_obo(spark: SparkSession, path: str, prefix: str = "CL:") -> tuple[DataFrame, DataFrame]:
    """Term stanzas of OBO text: `id`, `name`, `is_a` lines; other stanzas, tags and trailing comments do not matter."""
    text = spark.read.text(path, lineSep="\n[Term]")
    body = F.regexp_replace("value", r"^\[Term\]", "")
    body = F.split(body, r"\n\[", 2)[0]
    lines: Column = F.regexp_replace(F.concat(F.lit("\n"), body), r"\r", "")
    raw = text.where(~F.col("value").rlike(r"^\[(?!Term\])")).select(lines.alias("t"))
    every = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), 1)
    raw = raw.select(F.get(every(r"\nid:[ \t]*(\S+)"), 0).alias("term"), every(r"\nname:[ \t]*([^\n]*[^\s])").alias("labels"), every(r"\nis_a:[ \t]*(\S+)").alias("parents"))
    return _kept(raw.where("term is not null"), prefix)


def read_owl(spark: SparkSession, path: str, prefix: str = "CL_") -> tuple[DataFrame, DataFrame]:
    """Named classes of RDF/XML: `rdf:about`, `rdfs:label`, and `rdfs:subClassOf` with a named class; names are the last parts of addresses, with a colon."""
    rows = spark.read.format("xml").option("rowTag", "owl:Class").option("ignoreNamespace", "false").schema(_ELEMENT).load(path)
    name = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/#]*)$", 1), r"^([A-Za-z]+)_", "$1:")
    parents = F.transform(F.filter(F.coalesce("`rdfs:subClassOf`", F.array()), lambda p: p["_rdf:resource"].isNotNull()), lambda p: name(p["_rdf:resource"]))
    labels = F.filter(F.coalesce("`rdfs:label`", F.array().cast("array<string>")), lambda v: v.isNotNull())
    raw = rows.where("`_rdf:about` is not null").select(name(F.col("`_rdf:about`")).alias("term"), labels.alias("labels"), parents.alias("parents"))
    return _kept(raw, prefix.replace("_", ":"))


def write_obo(terms: DataFrame, edges: DataFrame, folder: str) -> None:
    """OBO text of terms(term, label) and edges(parent, child): a stanza a term, a line a label and a parent."""
    labels = terms.groupBy("term").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    parents = edges.groupBy(F.col("child").alias("term")).agg(F.sort_array(F.collect_list("parent")).alias("parents"))
    lines = lambda tag, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.concat(F.lit(tag), v))
    stanza = F.concat(F.array(F.lit("[Term]"), F.concat(F.lit("id: "), "term")), lines("name: ", "labels"), lines("is_a: ", "parents"), F.array(F.lit("")))
    labels.join(parents, "term", "left").select(F.array_join(stanza, "\n").alias("value")).write.text(folder)
