"""The triple view of graphs and pattern queries over it.

Triples are a set: node ids that several documents share are one node, and an attribute of such a node
may have several values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.model import KINDS, RELATIONS

TYPE = "rdf:type"


def plain(literal: Column) -> Column:
    """The text of a JSON literal."""
    return F.when(F.startswith(literal, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), literal, F.lit("}")), "$.v")).otherwise(literal)


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """s, p, o, o_is_iri, distinct. prov:type is rdf:type with a literal; every element also has the type of its kind;
    relations are IRI edges."""
    kind = F.concat(F.lit("prov:"), F.initcap("kind"))
    a = nodes.select(F.col("node_id").alias("s"), F.explode("attrs").alias("k", "v"))
    a = a.select("s", F.when(F.col("k") == "prov:type", TYPE).otherwise(F.col("k")).alias("p"), plain(F.col("v")).alias("o"), F.lit(False).alias("o_is_iri"))
    b = nodes.select(F.col("node_id").alias("s"), F.lit(TYPE).alias("p"), kind.alias("o"), F.lit(True).alias("o_is_iri"))
    e = edges.select(F.col("src").alias("s"), F.concat(F.lit("prov:"), F.col("rel")).alias("p"), F.col("dst").alias("o"), F.lit(True).alias("o_is_iri"))
    return a.unionByName(b).unionByName(e).distinct()


def predicate_counts(docs: DataFrame) -> DataFrame:
    """p, n: distinct triples by predicate of whole documents as rows (``generate.run_documents`` with plain attributes).

    A subject whose id holds the doc_id is in that document alone if no doc_id is a part of another id (doc_ids are
    unique, 32 hexadecimal digits, and ids join them by other characters): its triples are made distinct in
    the row. Only triples of the other subjects, which documents share, are shuffled.
    """
    own = lambda s: F.contains(s, F.col("doc_id"))
    triple = lambda s, p, o, iri: F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(iri).alias("o_is_iri"))
    alone = F.col("copies") == 1

    def of_node(kind: str):
        def said(n):
            named = lambda e: triple(n["node_id"], F.when(e["key"] == "prov:type", TYPE).otherwise(e["key"]), e["value"], False)
            return F.concat(F.transform(n["attrs"], named), F.array(triple(n["node_id"], F.lit(TYPE), F.lit(f"prov:{kind.capitalize()}"), True)))

        return said

    def of_edge(rel: str):
        return lambda e: triple(e["src"], F.lit(f"prov:{rel}"), e["dst"], True)

    def is_own(name: str):
        return lambda x: alone & F.coalesce(own(x[name]), F.lit(False))

    def is_shared(name: str):
        return lambda x: ~(alone & F.coalesce(own(x[name]), F.lit(False)))

    def of_kind(kind: str, test) -> Column:
        return F.flatten(F.transform(F.filter(kind, test("node_id")), of_node(kind)))

    def of_rel(rel: str, test) -> Column:
        return F.transform(F.filter(rel, test("src")), of_edge(rel))

    # In a document no two blocks share a triple: kinds differ in ids or types, relations in predicates. Nodes that
    # repeat an id are left to the shuffle.
    ids = F.concat(*[F.col(k)["node_id"] for k in KINDS])
    docs = docs.withColumn("copies", F.when(F.size(F.array_distinct(ids)) == F.size(ids), F.col("copies")).otherwise(F.lit(2)))
    own_nodes = [F.transform(of_kind(k, is_own), lambda t: t["p"]) for k in KINDS]
    text = lambda t: F.concat_ws("\x1f", t["s"], t["o"])
    own_edges = [F.array_repeat(F.lit(f"prov:{r}"), F.size(F.array_distinct(F.transform(of_rel(r, is_own), text)))) for r in RELATIONS]
    local = docs.select(F.explode(F.concat(*own_nodes, *own_edges)).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    shared = docs.select(F.inline(F.concat(*[of_kind(k, is_shared) for k in KINDS], *[of_rel(r, is_shared) for r in RELATIONS]))).distinct()
    return local.unionByName(shared.groupBy("p").agg(F.count("*").alias("n"))).groupBy("p").agg(F.sum("n").alias("n"))


def match(graph: DataFrame, *patterns: tuple[str, str, str], where: dict[str, str] | None = None) -> DataFrame:
    """Solutions of a basic graph pattern: terms that begin with ? are variables, others constants; patterns that share
    variables are joined on them. ``where`` fixes the text of variables. Distinct triples give a bag of solutions. A
    pattern that shares no variable with those before it is a ValueError: it would pair everything with everything."""
    out = None
    for terms in patterns:
        rows, names = graph, {}
        for column, term in zip("spo", terms, strict=True):
            if not term.startswith("?"):
                rows = rows.where(F.col(column) == term)
            elif term[1:] in names:
                rows = rows.where(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
        for v, text in (where or {}).items():
            if v in names:
                rows = rows.where(F.col(names[v]) == text)
        rows = rows.select(*[F.col(c).alias(v) for v, c in names.items()])
        if out is None:
            out = rows
        else:
            shared = [c for c in out.columns if c in rows.columns]
            if not shared:
                raise ValueError(f"pattern {terms} shares no variable with those before it")
            out = out.join(rows, shared)
    return out


def typed(nodes: DataFrame, ptype: str, name: str) -> DataFrame:
    """Ids of a type, distinct over documents: the filter reaches the scan."""
    return nodes.where(F.col("ptype") == ptype).select(F.col("node_id").alias(name)).distinct()


def _related(edges: DataFrame, rel: str, a: str, b: str) -> DataFrame:
    return edges.where(F.col("rel") == rel).select(F.col("src").alias(a), F.col("dst").alias(b)).distinct()


def count_runs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.where("ptype = 'openml:Experiment'").agg(F.countDistinct("node_id").alias("n"))


def per_fold_accuracies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Whatever has the attribute openml:accuracy; aggregates have another one, regression runs none."""
    rows = nodes.select(F.col("node_id").alias("m"), F.col("attrs")["openml:accuracy"].cast("double").alias("acc"))
    return rows.where("acc is not null").distinct()


def train_predict_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    chain = _related(edges, "wasInformedBy", "predict", "train")
    return chain.join(typed(nodes, "openml:Predict", "predict"), "predict", "left_semi").join(typed(nodes, "openml:Train", "train"), "train", "left_semi").select("predict", "train")


def model_lineage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _related(edges, "wasGeneratedBy", "model", "act").join(typed(nodes, "openml:Model", "model"), "model", "left_semi")


def aggregate_derivation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _related(edges, "wasDerivedFrom", "agg", "fold").join(typed(nodes, "openml:AggregateMetrics", "agg"), "agg", "left_semi")


#: id -> (description, query over (nodes, edges))
QUERIES: dict[str, tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]] = {
    "count_runs": ("Number of different experiments.", count_runs),
    "per_fold_accuracies": ("Accuracies of single folds, wherever an element has one.", per_fold_accuracies),
    "train_predict_chain": ("Predictions with the training step that came before.", train_predict_chain),
    "model_lineage": ("Models with the activity that made them.", model_lineage),
    "aggregate_derivation": ("Aggregate scores with the fold scores under them.", aggregate_derivation),
}


def summarise(found: DataFrame) -> tuple[int, int | str | None]:
    """(rows, value): the value of a result of one row and one column, as a whole number where it is one."""
    n = found.count()
    if n != 1 or len(found.columns) != 1:
        return n, None
    value = found.first()[0]
    try:
        return n, int(value)
    except (TypeError, ValueError):
        return n, str(value)
