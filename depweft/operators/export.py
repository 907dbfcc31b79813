"""The graph as files: JSON, an HTML page's data, Markdown notes, and a manifest of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweft.functions import fixed, keys
from depweft.operators import graph
from depweft.operators.notes import NOTE


def node_records(nodes: DataFrame, edges: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Exported nodes: id, type, status, depth, sha256, error, updated, usage struct, and note_json where a fresh note exists."""
    labels = graph.usage_labels(nodes, edges)
    usage = F.struct(F.col("usage").alias("status"), "declared_incoming", "inferred_incoming", "producers", "safe_to_delete").alias("usage")
    out = nodes.join(labels, "key", "left").select(F.col("key").alias("id"), F.col("kind").alias("type"), "status", "depth", F.col("digest").alias("sha256"), "error", "updated", usage)
    return out.join(notes.select(F.col("key").alias("id"), "note_json"), "id", "left") if notes is not None else out


def edge_records(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("from"), F.col("target").alias("to"), "relation", F.coalesce("evidence", F.lit("unknown")).alias("evidence"))


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON object per line under nodes/, by id, and edges/, by both ends; null fields included."""
    node_records(nodes, edges).orderBy("id").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/nodes")
    edge_records(edges).orderBy("from", "to", "relation").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/edges")


def audit_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """class, key of the coverage audit, in order."""
    return graph.audit_classes(nodes, edges).select("class", "key").orderBy("class", "key")


def write_audit(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The audit as JSON lines: counts/ with one object per class, and classes/ with the keys of each, in order. A class may hold most
    keys, so its keys are rows and not one list."""
    records = audit_records(nodes, edges)
    records.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy("class").write.mode("overwrite").json(f"{path}/counts")
    records.write.mode("overwrite").json(f"{path}/classes")


def embedded(text: Column) -> Column:
    """JSON that may stand in a script element."""
    out = text
    for raw, safe in (("<", "\\u003c"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def write_page(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The records as escaped JSON lines, for a page to embed."""
    for name, df in (("nodes", node_records(nodes, edges)), ("edges", edge_records(edges))):
        df.select(embedded(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def note_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Markdown notes as lines: note (file name), ordinal, line. Lines stay rows, so that a node with very many references is never
    gathered in one place; a writer partitions by note and sorts."""
    def part(section: int, df: DataFrame, order: list, line: Column) -> DataFrame:
        return df.select(keys.note_name(F.col("key")).alias("note"), F.lit(section).alias("section"), F.concat_ws("\x01", *order).alias("place"), line.alias("line"))

    link = lambda c: F.concat(F.lit("- [["), keys.note_name(F.col(c)), F.lit("]] ("), F.col("relation"), F.lit("; "), F.coalesce("evidence", F.lit("unknown")), F.lit(")"))
    use = ~F.col("relation").isin(fixed.STRUCTURAL)
    n = nodes.select("key", "kind", "status", "depth", "digest")
    heads = F.array(F.concat(F.lit("# "), F.translate("key", "[]", "")), F.concat(F.lit("- type: "), "kind"), F.concat(F.lit("- status: "), "status"), F.concat(F.lit("- depth: "), F.col("depth").cast("string")), F.concat(F.lit("- SHA256: "), F.coalesce("digest", F.lit("none"))))
    top = n.select("key", F.posexplode(heads).alias("i", "text"))
    out = part(0, top, [F.col("i").cast("string")], F.col("text"))
    out = out.unionByName(part(1, n, [F.lit("")], F.lit("## depends on"))).unionByName(part(3, n, [F.lit("")], F.lit("## referenced by")))
    out = out.unionByName(part(2, edges.where(use).withColumn("key", F.col("source")), ["target", "relation"], link("target")))
    return out.unionByName(part(4, edges.where(use).withColumn("key", F.col("target")), ["source", "relation"], link("source")))


def write_notes(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Lines of all notes, range-partitioned by note and sorted: each output file holds whole notes."""
    lines = note_lines(nodes, edges).repartitionByRange("note").sortWithinPartitions("note", "section", "place")
    lines.select("note", "section", "place", "line").write.mode("overwrite").parquet(path)


def markdown_lines(nodes: DataFrame, edges: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """note_lines with what else a note holds: error, containment either way, and the parts of a fresh explanation.

    notes: key, note_json, model. Angle brackets of explanations are escaped, as a model wrote them.
    """

    def rows(df: DataFrame, section: int, place: Column, line: Column) -> DataFrame:
        return df.select(keys.note_name(F.col("key")).alias("note"), F.lit(section).alias("section"), place.alias("place"), line.alias("line"))

    out = note_lines(nodes, edges).unionByName(rows(nodes.where(F.col("error").isNotNull()), 0, F.lit("9"), F.concat(F.lit("- error: "), F.left(F.translate("error", "\n", " "), F.lit(450)))))
    inside = edges.where(F.col("relation").isin(fixed.STRUCTURAL))
    for section, title, own, other in ((5, "## contains", "source", "target"), (7, "## lies in", "target", "source")):
        out = out.unionByName(rows(nodes, section, F.lit(""), F.lit(title)))
        out = out.unionByName(rows(inside.withColumn("key", F.col(own)), section + 1, F.col(other), F.concat(F.lit("- [["), keys.note_name(F.col(other)), F.lit("]]"))))
    if notes is None:
        return out
    told = notes.select("key", "model", F.from_json("note_json", NOTE).alias("n")).where(F.col("n.summary").isNotNull())
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    items = lambda name: F.transform(F.coalesce(F.col(f"n.{name}"), F.array().cast("array<string>")), lambda v: F.concat(F.lit("- "), safe(v)))
    text = F.concat(F.array(F.lit("## explanation"), F.lit("> Written by a model; check it against the code."), F.concat(F.lit("model: "), F.coalesce("model", F.lit("unknown"))), safe(F.col("n.summary"))), F.array(F.lit("### responsibilities")), items("responsibilities"), F.array(F.lit("### important symbols")), items("important_symbols"),
                    *(F.array(F.lit(f"### {title}"), safe(F.col(f"n.{name}"))) for title, name in (("inputs and outputs", "inputs_outputs"), ("notes", "notes"), ("limitations", "limitations"))))
    lines = told.select("key", F.posexplode(text).alias("i", "line"))
    return out.unionByName(rows(lines, 9, F.format_string("%04d", F.col("i")), F.col("line")))


def index_lines(nodes: DataFrame) -> DataFrame:
    """Links to all notes, by key: key, line."""
    return nodes.select("key", F.concat(F.lit("- [["), keys.note_name(F.col("key")), F.lit("|"), F.translate(F.translate("key", "|", "-"), "]", ""), F.lit("]]")).alias("line")).orderBy("key")


def explanation_lines(notes: DataFrame) -> DataFrame:
    """Links to the notes that hold an explanation, with the start of its summary: key, line."""
    summary = F.translate(F.left(F.get_json_object("note_json", "$.summary"), F.lit(240)), "\n", " ")
    return notes.where(summary.isNotNull()).select("key", F.concat(F.lit("- [["), keys.note_name(F.col("key")), F.lit("]]: "), summary).alias("line")).orderBy("key")


def write_markdown(nodes: DataFrame, edges: DataFrame, path: str, notes: DataFrame | None = None) -> None:
    """Text files: notes/note=<name>/ with the lines of one note in order, index/ and explanations/ with the two indexes. All lines of a
    note are written by one task, which streams them."""
    lines = markdown_lines(nodes, edges, notes).repartitionByRange("note").sortWithinPartitions("note", "section", "place")
    lines.select("note", "line").write.mode("overwrite").partitionBy("note").text(f"{path}/notes")
    index_lines(nodes).select("line").write.mode("overwrite").text(f"{path}/index")
    told = explanation_lines(notes) if notes is not None else nodes.limit(0).select("key", F.lit("").alias("line"))
    told.select("line").write.mode("overwrite").text(f"{path}/explanations")


def file_manifest(files: DataFrame) -> DataFrame:
    """path, sha256 of written contents (path string, content binary)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def leaks(texts: DataFrame) -> DataFrame:
    """Outputs that hold a local user folder or a private key. texts: name, text."""
    return texts.where(F.col("text").rlike(fixed.LEAKS)).select("name")

