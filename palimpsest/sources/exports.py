"""Exports of the graph: JSON documents and a script of CREATE statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_nodes(nodes: DataFrame, label: str, properties: list[str], namespaces: list[str] | None = None) -> DataFrame:
    """One JSON text per node: its label and its non-null properties; a namespace filter also lets global ones through."""
    if namespaces:
        nodes = nodes.where(F.col("namespace").isin([*namespaces, "global"]))
    return nodes.select(F.to_json(F.struct(F.array(F.lit(label)).alias("labels"), F.struct(*properties).alias("properties"))).alias("json"))


def all_nodes(kinds: dict[str, tuple[DataFrame, list[str]]], strip: list[str] | None = None, namespaces: list[str] | None = None) -> DataFrame:
    """label, json of the nodes of several kinds (label: table, properties), without the properties in ``strip``."""
    out = None
    for label, (nodes, properties) in kinds.items():
        own = namespaces if "namespace" in nodes.columns else None
        part = json_nodes(nodes, label, [p for p in properties if p not in (strip or [])], own).select(F.lit(label).alias("label"), "json")
        out = part if out is None else out.unionByName(part)
    return out


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def create_nodes(nodes: DataFrame, label: str, properties: list[str]) -> DataFrame:
    """One CREATE statement per node, null properties left out."""
    parts = [F.when(F.col(p).isNotNull(), F.concat(F.lit(f"{p}: "), quoted(F.col(p).cast("string")))) for p in properties]
    return nodes.select(F.concat(F.lit(f"CREATE (:{label} {{"), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ", "), F.lit("});")).alias("statement"))


def create_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """One statement per edge, ends matched by name."""
    n = lambda c: names.select(F.col("concept_id").alias(c), F.col("name").alias(f"{c}_name"))
    e = edges.join(n("src"), "src").join(n("dst"), "dst")
    text = F.concat(F.lit("MATCH (a:Concept {name: "), quoted(F.col("src_name")), F.lit("}), (b:Concept {name: "), quoted(F.col("dst_name")), F.lit("}) CREATE (a)-[:"), "rel_type", F.lit("]->(b);"))
    return e.select(text.alias("statement"))
