"""Ontology text, closures over several parents, distances, on random graphs against plain Python."""

import random
from collections import deque

import pytest

from rowloom.operators import ontology
from rowloom.sources import ontologies

OBO = """format-version: 1.2
ontology: t

[Term]
id: CL:1
name: cell
def: "A [Term] of its own." []

[Term]
id: CL:2 
name: two words  
is_a: CL:1 ! cell
is_a: GO:9 ! not kept
relationship: part_of CL:1

[Term]
id: CL:3
name: three
name: drei
is_a: CL:1

[Term]
id: CL:4
name: four
is_a: CL:2 ! two words
is_a: CL:1 {source="x"} ! cell
is_a: CL:3
is_obsolete: true

[Term]
id: CL:5

[Term]
id: GO:9
name: process

[Typedef]
id: CL:part_of
name: part of
is_a: CL:1
"""

OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">
  <owl:Class rdf:about="http://x/obo/CL_1"><rdfs:label rdf:datatype="http://x#string">cell</rdfs:label></owl:Class>
  <owl:Class rdf:about="http://x/obo/CL_2">
    <owl:equivalentClass><owl:Class><owl:intersectionOf><rdf:Description rdf:about="http://x/obo/CL_1"/></owl:intersectionOf></owl:Class></owl:equivalentClass>
    <rdfs:subClassOf rdf:resource="http://x/obo/CL_1"/>
    <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x/obo/RO_1"/></owl:Restriction></rdfs:subClassOf>
    <rdfs:label xml:lang="en">two words</rdfs:label>
  </owl:Class>
  <owl:Class rdf:about="http://x/obo/CL_3"><rdfs:subClassOf rdf:resource="http://x/obo/CL_1"/><rdfs:label>three</rdfs:label><rdfs:label>drei</rdfs:label></owl:Class>
  <owl:Class rdf:about="http://x/obo/CL_4"><rdfs:subClassOf rdf:resource="http://x/obo/CL_2"/><rdfs:subClassOf rdf:resource="http://x/obo/CL_1"/><rdfs:subClassOf rdf:resource="http://x/obo/CL_3"/><rdfs:label>four</rdfs:label></owl:Class>
  <owl:Class rdf:about="http://x/obo/CL_5"/>
  <owl:Class rdf:about="http://x/obo/GO_9"><rdfs:label>process</rdfs:label></owl:Class>
</rdf:RDF>"""

TERMS = [("CL:1", "cell"), ("CL:2", "two words"), ("CL:4", "four")]
EDGES = [("CL:1", "CL:2"), ("CL:1", "CL:4"), ("CL:2", "CL:4")]


@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_obo_text(spark, tmp_path, line):
    (tmp_path / "t.obo").write_bytes(OBO.replace("\n", line).encode())
    terms, edges = ontologies.read_obo(spark, str(tmp_path / "t.obo"))
    assert sorted(map(tuple, terms.collect())) == TERMS and sorted(map(tuple, edges.collect())) == EDGES


def test_rdf_xml(spark, tmp_path):
    (tmp_path / "t.owl").write_text(OWL)
    terms, edges = ontologies.read_owl(spark, str(tmp_path / "t.owl"))
    assert sorted(map(tuple, terms.collect())) == TERMS and sorted(map(tuple, edges.collect())) == EDGES


def _graph(seed, n):
    rng = random.Random(seed)
    return [(f"t{rng.randrange(k)}", f"t{k}") for k in range(1, n) for _ in range(rng.choice([1, 1, 2, 3]))] + [("x", "y")]


def _walk(edges, start):
    dist, todo = {start: 0}, deque([start])
    while todo:
        a = todo.popleft()
        for p, c in edges:
            if p == a and c not in dist:
                dist[c] = dist[a] + 1
                todo.append(c)
    return dist


def test_closure_and_distances_of_random_graphs(spark):
    edges = _graph(5, 60)
    df = spark.createDataFrame(edges + [("t3", "t3"), edges[0]], "parent string, child string")
    terms = {t for e in edges for t in e}
    want = {(a, b): d for a in terms for b, d in _walk(edges, a).items()}
    assert {(r[0], r[1]): r[2] for r in ontology.closure(df).select("ancestor", "descendant", "dist").collect()} == want
    both = edges + [(c, p) for p, c in edges]
    want = {(a, b): d for a in terms for b, d in _walk(both, a).items()} | {("unknown", "unknown"): 0}
    got = ontology.distances(df, "unknown").collect()
    assert {(r["a"], r["b"]): r["dist"] for r in got} == want and len(got) == len(want)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "parent long, child long")
    rounds = []
    real = ontology._written
    monkeypatch.setattr(ontology, "_written", lambda df, name: rounds.append(name) or real(df, name))
    c = ontology.closure(chain)
    assert c.count() == 201 * 202 // 2 and c.agg({"dist": "max"}).first()[0] == 200
    assert len(rounds) <= 11


def test_cycles_and_sizes_are_refused(spark, monkeypatch):
    with pytest.raises(ValueError, match="cycle"):
        ontology.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("r", "a")], "parent string, child string"))
    assert ontology.closure(spark.createDataFrame([], "parent string, child string")).count() == 0
    assert ontology.distances(spark.createDataFrame([], "parent string, child string")).count() == 0
    monkeypatch.setattr(ontology, "MOST_LINKS", 1)
    with pytest.raises(ValueError, match="links"):
        ontology.distances(spark.createDataFrame(EDGES, "parent string, child string"))
