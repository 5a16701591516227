"""JSON documents, JSON lines, GraphML and sentence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.operators.records import numbered


def read_json_document(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """``pos, key, value.*`` of files that each hold one object of objects. ``value_schema``: DDL of a value. A file is read
    whole by one task, as its format asks for."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", T.MapType(T.StringType(), T.StructType.fromDDL(value_schema)))
    return whole.select(F.posexplode(F.map_entries(entries)).alias("pos", "e")).select("pos", F.col("e.key").alias("key"), "e.value.*")


def json_document_lines(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``pos, line``: a JSON document of an object for each key, indented by two, with characters beyond ASCII as they are;
    by ``pos`` the lines are the document. A key should be unique and not NULL; a NULL value is null."""
    def value(c: str):  # noqa: ANN202
        written = F.to_json(F.array(c), {"ignoreNullFields": "false"})
        return F.substring(written, F.lit(2), F.length(written) - 2)

    fields = F.concat_ws(",\n", *(F.concat(F.lit(f'    "{c}": '), value(c)) for c in columns))
    placed = numbered(df, key, name="_pos")
    last = placed.agg(F.max("_pos").alias("_last"))  # one row
    entry = F.concat(F.lit("  "), value(key), F.lit(": {\n"), fields, F.lit("\n  }"), F.when(F.col("_pos") < F.col("_last"), ",").otherwise(""))
    lines = placed.crossJoin(F.broadcast(last)).select((F.col("_pos") + 1).alias("pos"), entry.alias("line"))
    frame = df.sparkSession.createDataFrame([(0, "{"), ((1 << 62), "}")], "pos long, line string")
    return frame.unionByName(lines)


def write_json_document(df: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """One JSON document in folder ``path``, as ``read_json_document`` takes it: for tables that one task can write; larger
    ones are kept as parquet or JSON lines."""
    json_document_lines(df, key, columns).coalesce(1).sortWithinPartitions("pos").select("line").write.mode("overwrite").text(path)


def write_metrics(metrics: dict[str, float], path: str, step: int, spark: SparkSession) -> None:
    """A step's metrics as rows ``step, metric, value`` of the parquet table at ``path``, in a folder by step: a step that
    is written again replaces itself. Values that are no numbers are left out."""
    rows = [(k, float(v)) for k, v in metrics.items() if isinstance(v, (int, float))]
    spark.createDataFrame(rows, "metric string, value double").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/step={step}")


def log_line(metrics: dict[str, object], step: int) -> str:
    """A step's numbers in one line: ``step:3 - loss:0.250``."""
    return " - ".join([f"step:{step}", *(f"{k}:{v:.3f}" for k, v in metrics.items() if isinstance(v, (int, float)))])


def write_json_lines(df: DataFrame, path: str, first: bool = False) -> None:
    """Rows appended as JSON lines; at the first step what was there is replaced."""
    df.write.mode("overwrite" if first else "append").json(path)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """``sentence`` of each line, without white space at its end."""
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)\s+$", "").alias("sentence"))


# Fixed value: the frame of a GraphML file.
GRAPHML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    '<key id="role" for="node" attr.name="role" attr.type="string"/>\n<key id="entity_type" for="node" attr.name="entity_type" attr.type="string"/>\n'
    '<key id="description" for="node" attr.name="description" attr.type="string"/>\n<key id="weight" for="all" attr.name="weight" attr.type="double"/>\n'
    '<graph edgedefault="undirected">'
)
GRAPHML_TAIL = "</graph>\n</graphml>"


def _escaped(c: str):  # noqa: ANN202
    x = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``section, line``: GraphML text, a line for each node and edge; sorted by section it is a file."""
    def data(key: str, value) -> object:  # noqa: ANN001
        return F.when(value.isNotNull(), F.concat(F.lit(f'<data key="{key}">'), value, F.lit("</data>"))).otherwise(F.lit(""))

    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, GRAPHML_HEAD), (3, GRAPHML_TAIL)], "section int, line string")
    n = nodes.select(F.lit(1).alias("section"), F.concat(F.lit('<node id="'), _escaped("id"), F.lit('">'), data("role", _escaped("role")), data("entity_type", _escaped("entity_type")), data("description", _escaped("description")), data("weight", F.col("weight").cast("string")), F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("section"), F.concat(F.lit('<edge source="'), _escaped("src"), F.lit('" target="'), _escaped("dst"), F.lit('">'), data("weight", F.col("weight").cast("string")), F.lit("</edge>")).alias("line"))
    return frame.unionByName(n).unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML file in folder ``path``. The format is one document, so it is for graphs that one task can write; large
    graphs are kept as parquet."""
    graphml_lines(nodes, edges).coalesce(1).sortWithinPartitions("section").select("line").write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, role, entity_type, description, weight``) and edges (``src, dst, weight``) of GraphML files."""
    data = "array<struct<_key:string,_VALUE:string>>"

    def value(key: str):  # noqa: ANN202
        return F.try_element_at(F.filter("data", lambda d: d["_key"] == key), F.lit(1))["_VALUE"]

    read = spark.read.format("xml")
    n = read.option("rowTag", "node").schema(f"_id string, data {data}").load(path)
    e = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {data}").load(path)
    nodes = n.select(F.col("_id").alias("id"), value("role").alias("role"), value("entity_type").alias("entity_type"), value("description").alias("description"), value("weight").cast("double").alias("weight"))
    return nodes, e.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), value("weight").cast("double").alias("weight"))


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as dotted ones; an array also gives ``<name>.list_len`` and is kept as JSON."""
    out = []

    def walk(name: str, path: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{name}.{f.name}", f"{path}.`{f.name}`", f.dataType)
        elif isinstance(kind, T.ArrayType):
            out.append(F.size(F.col(path)).alias(f"{name}.list_len"))
            out.append(F.to_json(F.col(path)).alias(name))
        else:
            out.append(F.col(path).alias(name))

    for f in df.schema.fields:
        walk(f.name, f"`{f.name}`", f.dataType)
    return df.select(*out)
