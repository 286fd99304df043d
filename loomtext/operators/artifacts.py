"""Artifacts of runs: what the results of actions refer to, the graph of what follows from what, and its cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import lineage

# The kinds of artifacts and the fields that name their paths, in the order in which they count: of the result, then of its outputs.
FIELDS = (
    ("manifest", ("result.manifest_path",)), ("work_dir", ("result.work_dir", "context.work_dir")), ("glossary", ("result.glossary_path", "context.glossary_path")),
    ("normalized_document", ("result.normalized_document_path", "context.normalized_document_path")), ("output_file", ("result.output_file", "context.output_file")),
    ("output_path", ("result.output_path", "context.output_path")), ("optimized_text", ("result.optimized_text", "context.optimized_text_path")),
    ("state", ("context.state_path", "context.state_ref")), ("telemetry", ("context.telemetry_path",)),
    ("work_dir", ("outputs.work_dir",)), ("output_file", ("outputs.output_file",)), ("optimized_text", ("outputs.optimized_text",)),
)
_PARENTS = "array<string>"


def content_id(kind: Column, path: Column, version: Column) -> Column:
    """An artifact's id by what it is: kind, path and version."""
    return F.concat(F.lit("artifact_"), F.left(F.sha1(F.concat_ws(":", F.lit("artifact"), kind, path, version.cast("string")).cast("binary")), F.lit(12)))


def derive(results: DataFrame) -> DataFrame:
    """(run_id, action_id, k, artifact_id, artifact_type, path, source_action_id, version, parent_artifacts, quality_status) of results (run_id, action_id, result, context).

    result and context are JSON objects. Artifacts that a result lists come first, in their order, a path once; then those that its path fields and
    the context's name, if no earlier one of the action has that path. An artifact without id gets its content_id.
    """
    part = "array<struct<artifact_id:string,artifact_type:string,path:string,source_action_id:string,version:string,parent_artifacts:array<string>,quality_status:string>>"
    at = lambda c, name: T.strip(T.text_of(F.get_json_object(c, f"$.{name}")))
    sources = {"result": lambda n: at("result", n), "context": lambda n: at("context", n), "outputs": lambda n: at("result", f"outputs.{n}")}

    def first_of(fields: tuple[str, ...]) -> Column:
        values = [sources[s](n) for s, n in (f.split(".") for f in fields)]
        return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))

    listed = F.coalesce(F.from_json(F.get_json_object("result", "$.artifacts"), part), F.array().cast(part))
    entry = lambda a: F.struct(
        T.strip(T.text_of(a["artifact_id"])).alias("artifact_id"),
        F.coalesce(F.nullif(T.strip(T.text_of(a["artifact_type"])), F.lit("")), F.lit("unknown")).alias("artifact_type"),
        T.strip(T.text_of(a["path"])).alias("path"),
        F.coalesce(F.nullif(T.strip(T.text_of(a["source_action_id"])), F.lit("")), F.col("action_id")).alias("source_action_id"),
        F.greatest(F.lit(1), F.coalesce(a["version"].try_cast("int"), F.lit(1))).alias("version"),
        F.filter(F.transform(F.coalesce(a["parent_artifacts"], F.array().cast(_PARENTS)), lambda p: T.strip(T.text_of(p))), lambda p: p != "").alias("parent_artifacts"),
        T.strip(T.text_of(a["quality_status"])).alias("quality_status"),
    )
    named = [F.struct(F.lit("").alias("artifact_id"), F.lit(kind).alias("artifact_type"), first_of(fields).alias("path"), F.col("action_id").alias("source_action_id"), F.lit(1).alias("version"), F.array().cast(_PARENTS).alias("parent_artifacts"), F.lit("").alias("quality_status")) for kind, fields in FIELDS]
    own = F.concat(F.transform(F.filter(listed, lambda a: a.isNotNull()), entry), F.filter(F.array(*named), lambda a: a["path"] != ""))
    once = T.let(own, lambda all_: F.filter(all_, lambda a, i: (a["path"] == "") | (F.array_position(all_["path"], a["path"]) == i + 1)))
    rows = results.select("run_id", "action_id", F.posexplode(once).alias("k", "a")).select("run_id", "action_id", "k", "a.*")
    return rows.withColumn("artifact_id", F.coalesce(F.nullif(F.col("artifact_id"), F.lit("")), content_id(F.col("artifact_type"), F.col("path"), F.col("version"))))


def graph(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of derived artifacts: (run_id, artifact_id, artifact_type, path), each id once, by its first action, and (run_id, from_id, to_id), each once."""
    w = Window.partitionBy("run_id", "artifact_id").orderBy("action_id", "k")
    nodes = artifacts.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("run_id", "artifact_id", "artifact_type", "path")
    edges = artifacts.select("run_id", F.explode("parent_artifacts").alias("from_id"), F.col("artifact_id").alias("to_id")).distinct()
    return nodes, edges


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle) for the nodes of edges (from_id, to_id) that lie on cycles; nodes that reach each other have the same cycle, named by its greatest node.

    Nodes without a way in or out are trimmed, round by round. Of what is left each node takes the greatest node that reaches it; a node that
    takes itself and those that reach it within its own colour are one strongly connected component. These go, and the rest is treated again.
    Every step is a join of narrow rows, written to the checkpoint folder.
    """
    found = None
    now = lineage.cut(edges.where("from_id IS NOT NULL AND to_id IS NOT NULL").select("from_id", "to_id").distinct())
    while True:
        n = now.count()
        while True:  # trimming
            now = lineage.cut(now.join(now.select(F.col("to_id").alias("from_id")).distinct(), "from_id").join(now.select(F.col("from_id").alias("to_id")).distinct(), "to_id"))
            if (left := now.count()) == n:
                break
            n = left
        if not n:
            break
        colour = lineage.cut(now.select(F.col("from_id").alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            met = now.join(colour.withColumnRenamed("node", "from_id"), "from_id").groupBy(F.col("to_id").alias("node")).agg(F.max("c").alias("m"))
            after = lineage.cut(colour.join(met, "node").select("node", F.greatest("c", "m").alias("c"), (F.col("m") > F.col("c")).alias("moved")))
            colour, moved = after.drop("moved"), after.where("moved").take(1)
            if not moved:
                break
        of = lambda c: colour.select(F.col("node").alias(c), F.col("c").alias(f"{c}_c"))
        inner = lineage.cut(now.join(of("from_id"), "from_id").join(of("to_id"), "to_id").where("from_id_c = to_id_c").select("from_id", "to_id", F.col("from_id_c").alias("c")))
        members = lineage.cut(colour.where("node = c").select("node", "c"))
        n_members = members.count()
        while True:
            back = inner.join(members.select(F.col("node").alias("to_id")), "to_id").select(F.col("from_id").alias("node"), "c")
            members = lineage.cut(members.unionByName(back).distinct())
            if (more := members.count()) == n_members:
                break
            n_members = more
        # a root alone is a cycle only if an edge leads from it to itself
        sized = members.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("c")))
        loops = now.where("from_id = to_id").select(F.col("from_id").alias("node"), F.lit(True).alias("_loop"))
        part = lineage.cut(sized.join(loops, "node", "left").where("_n > 1 OR _loop").select("node", F.col("c").alias("cycle")))
        found = part if found is None else found.unionByName(part)
        gone = members.select("node")
        now = lineage.cut(now.join(gone.withColumnRenamed("node", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("node", "to_id"), "to_id", "left_anti").select("from_id", "to_id"))
    return found if found is not None else edges.sparkSession.createDataFrame([], edges.select(F.col("from_id").alias("node"), F.col("from_id").alias("cycle")).schema)
