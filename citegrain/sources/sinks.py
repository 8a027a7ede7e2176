"""Writers: records, edges, graphs, sheets. Tables are written by Spark in parallel; a graph drawing format is one small file."""

from __future__ import annotations

import json
from html import escape
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import cut

#: Columns of the CSV of records.
COLUMNS = ("scopus_id", "doi", "title", "creator", "venue", "issn", "cover_date", "year", "venue_type", "cited_by_count", "source_id")
INLINE = 50


def write_records(df: DataFrame, path: str) -> None:
    """JSON of all columns and CSV of the fixed ones that there are."""
    df.write.mode("errorifexists").json(f"{path}/json")
    df.select(*[c for c in COLUMNS if c in df.columns]).write.option("header", True).csv(f"{path}/csv")


def goes_to_file(df: DataFrame) -> bool:
    """Whether there are more rows than fit inline; counts INLINE + 1 of them at most."""
    return df.limit(INLINE + 1).count() > INLINE


def flat(df: DataFrame) -> DataFrame:
    """Structs year, value become x and x_year, arrays are joined by '; '."""
    cols = []
    for name, kind in df.dtypes:
        if kind.startswith("struct<") and "year:" in kind and "value:" in kind:
            cols += [F.col(f"{name}.value").alias(name), F.col(f"{name}.year").alias(f"{name}_year")]
        elif kind.startswith("array<"):
            cols.append(F.array_join(F.col(name).cast("array<string>"), "; ").alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def compact(df: DataFrame) -> DataFrame:
    """line: each row as JSON without nulls and blanks."""
    cols = [F.when(F.trim(F.col(c)) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("line"))


def page(df: DataFrame, order: list, number: int, size: int = 50) -> DataFrame:
    """One page of the ordered rows; the number is brought into 1..pages."""
    pages = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(1, number), pages) - 1) * size).limit(size)


#: The fields of a record's short form.
SHORT = ("scopus_id", "openalex_id", "doi", "year", "creator", "title", "publication_name", "issn", "cited_by_count")


def result_lines(records: DataFrame, order: list, inline: str = "sample", most: int = 10) -> DataFrame:
    """place, line: records as JSON in the order, as they are shown beside a table that goes to a file (goes_to_file).

    inline: sample (all fields of the first ``most``), compact (the short form of all, the year from cover_date where it is
    missing) or full (all fields of all); anything else: ValueError. Nulls and blanks are left out.
    """
    if inline not in ("sample", "compact", "full"):
        raise ValueError("inline must be sample, compact or full")
    if inline == "compact":
        has = set(records.columns)
        if "cover_date" in has:
            dated = F.substring(F.col("cover_date").cast("string"), 1, 4)
            year = F.coalesce(F.col("year").cast("string"), dated) if "year" in has else dated
            records, has = records.withColumn("year", year), has | {"year"}
        shown = [c for c in SHORT if c in has]
    else:
        shown = records.columns
        records = records.orderBy(*order).limit(most) if inline == "sample" else records
    numbered_rows = numbered(records, order).withColumnRenamed("index", "_place")
    kinds = dict(numbered_rows.dtypes)
    fields = [F.when(F.trim(F.col(c)) != "", F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in shown]
    return numbered_rows.select(F.col("_place").alias("place"), F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("line"))


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with index, from 1 in the order: rows are sorted by range, and a row's index is its place within its range after the sizes of those before."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": part, "_place": place}))
    sizes = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return sorted_rows.join(F.broadcast(before), "_part").withColumn("index", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def vertices(nodes: DataFrame) -> DataFrame:
    """index (from 1, by id), node, label with double quotes made single."""
    return numbered(nodes, ["node"]).select("index", "node", F.replace(F.coalesce("label", F.col("node").cast("string")), F.lit('"'), F.lit("'")).alias("label"))


def arcs(index: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, weight by vertex index; edges with unknown ends are dropped."""
    one, two = index.select(F.col("node").alias("source"), F.col("index").alias("a")), index.select(F.col("node").alias("target"), F.col("index").alias("b"))
    return edges.join(one, "source").join(two, "target").select("a", "b", "weight")


def write_pajek(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A .net file of vertices and arcs, row by row through the driver."""
    index = vertices(nodes).cache()
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"*Vertices {index.count()}\n")
        for i, label in index.select("index", "label").orderBy("index").toLocalIterator():
            f.write(f'{i} "{label}"\n')
        f.write("*Arcs\n")
        for a, b, w in arcs(index, edges).orderBy("a", "b").toLocalIterator():
            f.write(f"{a} {b}" + (f" {w}" if w is not None else "") + "\n")
    index.unpersist()


def pajek_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a .net file as rows: block and place give their order; to be written by Spark where a driver's file is too small."""
    index = vertices(nodes)
    number = lambda c: F.coalesce(F.concat(F.lit(" "), F.col(c).cast("string")), F.lit(""))
    block = lambda k, place, line: (F.lit(k).alias("block"), place.cast("long").alias("place"), line.alias("line"))
    out = nodes.agg(F.count(F.lit(1)).alias("n")).select(*block(0, F.lit(0), F.concat(F.lit("*Vertices "), F.col("n").cast("string"))))
    out = out.unionByName(index.select(*block(1, F.col("index"), F.concat(F.col("index").cast("string"), F.lit(' "'), F.col("label"), F.lit('"')))))
    out = out.unionByName(nodes.sparkSession.range(1).select(*block(2, F.lit(0), F.lit("*Arcs"))))
    return out.unionByName(arcs(index, edges).select(*block(3, F.col("a"), F.concat(F.col("a").cast("string"), number("b"), number("weight")))))


def write_partition(nodes: DataFrame, path: str) -> None:
    """A .clu file: the class (part) of each node, by id."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"*Vertices {nodes.count()}\n")
        f.writelines(f"{r[0]}\n" for r in nodes.orderBy("node").select("part").toLocalIterator())


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (node, any columns) and edges (source, target, weight, cosine) as GraphML; nulls are left out."""
    fields = [c for c in nodes.columns if c != "node"]
    measures = [c for c in edges.columns if c not in ("source", "target")]
    data = lambda row, cs: "".join(f'<data key="{c}">{escape(str(row[c]))}</data>' for c in cs if row[c] is not None)
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        f.writelines(f'<key id="{c}" for="node" attr.name="{c}" attr.type="string"/>\n' for c in fields)
        f.writelines(f'<key id="{c}" for="edge" attr.name="{c}" attr.type="double"/>\n' for c in measures)
        f.write('<graph edgedefault="undirected">\n')
        for r in nodes.orderBy("node").toLocalIterator():
            f.write(f'<node id="{escape(str(r.node))}">{data(r, fields)}</node>\n')
        for r in edges.orderBy("source", "target").toLocalIterator():
            f.write(f'<edge source="{escape(str(r.source))}" target="{escape(str(r.target))}">{data(r, measures)}</edge>\n')
        f.write("</graph>\n</graphml>\n")


def write_lineage(seed: str, records: DataFrame, path_nodes: list, spc_edges: DataFrame, path: str, most: int = 100_000) -> None:
    """A lineage as one JSON file: seed_id, records, main_path, spc_edges. More than ``most`` rows: ValueError."""
    rows = [[json.loads(x) for (x,) in islice(df.select(F.to_json(F.struct("*"))).toLocalIterator(), most + 1)] for df in (records, spc_edges)]
    if any(len(x) > most for x in rows):
        raise ValueError(f"more than {most} rows; write a table instead")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"seed_id": seed, "records": rows[0], "main_path": path_nodes, "spc_edges": rows[1]}, f, ensure_ascii=False)


def coding_sheet(edges: DataFrame) -> DataFrame:
    """edges with two blank columns for the coders, and contexts joined."""
    return flat(edges).withColumns({"coder_1_label": F.lit(""), "coder_2_label": F.lit("")})


def html_page(nodes: DataFrame, edges: DataFrame, title: str, most: int = 2_000) -> str:
    """A page that draws a layered network (node, x, y and more; source, target), its data as inline JSON; more than ``most`` nodes or edges: ValueError.

    Without x and y the edges are listed.
    """
    rows = [[r.asDict() for r in df.limit(most + 1).collect()] for df in (nodes, edges)]
    if any(len(x) > most for x in rows):
        raise ValueError(f"more than {most} nodes or edges; write tables instead")
    data = json.dumps({"nodes": rows[0], "edges": rows[1]}, default=str).replace("</", "<\\/")
    head = f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1>'
    read = "const d=JSON.parse(document.getElementById('data').textContent);"
    if "x" in nodes.columns and "y" in nodes.columns:
        body = '<svg id="net" xmlns="http://www.w3.org/2000/svg"></svg>'
        script = read + (
            "const s=document.getElementById('net'),at=new Map(d.nodes.map(n=>[String(n.node),n]));"
            "const put=(k,a,t)=>{const e=document.createElementNS(s.namespaceURI,k);for(const x in a)e.setAttribute(x,a[x]);if(t!==undefined)e.textContent=t;s.append(e)};"
            "s.setAttribute('width',Math.max(0,...d.nodes.map(n=>n.x))+80);s.setAttribute('height',Math.max(0,...d.nodes.map(n=>n.y))+80);"
            "for(const e of d.edges){const a=at.get(String(e.source)),b=at.get(String(e.target));if(a&&b)put('line',{x1:a.x,y1:a.y,x2:b.x,y2:b.y,stroke:'#999'})}"
            "for(const n of d.nodes){put('circle',{cx:n.x,cy:n.y,r:6});put('text',{x:n.x,y:n.y+20,'text-anchor':'middle','font-size':10},n.label||n.node)}"
        )
    else:
        body = '<ul id="list"></ul>'
        script = read + "const u=document.getElementById('list');for(const e of d.edges){const li=document.createElement('li');li.textContent=e.source+' → '+e.target;u.append(li)}"
    return f'{head}{body}<script type="application/json" id="data">{data}</script><script>{script}</script>'


def write_texts(texts: DataFrame, path: str) -> None:
    """Full texts (paper_id, text) as text files in a folder for each paper; papers without text have none."""
    texts.where("text is not null").select("paper_id", "text").write.partitionBy("paper_id").text(path)


def write_bibtex(entries: DataFrame, path: str) -> None:
    """Entries (pos, entry) as BibTeX files in the order of pos, a blank line after each."""
    entries.orderBy("pos").select(F.concat("entry", F.lit("\n")).alias("value")).write.text(path)


def write_sheet(edges: DataFrame, path: str) -> None:
    """A coding sheet as CSV files, each with the mark at its beginning by which spreadsheets know UTF-8."""
    sheet = coding_sheet(edges)
    sheet.withColumnRenamed(sheet.columns[0], "\ufeff" + sheet.columns[0]).write.option("header", True).option("escape", '"').csv(path)


#: What the manifest of a corpus says that it is.
CORPUS_KIND = "citegrain corpus"


def write_corpus(records: DataFrame, path: str) -> None:
    """Imported records (scopus_id, doi and more) as a corpus: a table, and a manifest with its kind."""
    records.write.parquet(f"{path}/records")
    records.sparkSession.range(1).select(F.lit(CORPUS_KIND).alias("kind")).coalesce(1).write.json(f"{path}/manifest")


def corpus_ids(spark: SparkSession, path: str, by: str = "scopus_id") -> DataFrame:
    """paper_id: the ids (by scopus_id or doi) of a corpus, distinct. Something else at the path, or no ids: ValueError."""
    try:
        kinds = [r.kind for r in spark.read.schema("kind string").json(f"{path}/manifest").collect()]
    except AnalysisException:
        kinds = []
    if kinds != [CORPUS_KIND]:
        raise ValueError(f"{path} is no corpus")
    ids = spark.read.parquet(f"{path}/records").select(F.col(by).alias("paper_id")).where("paper_id is not null").distinct()
    if ids.isEmpty():
        raise ValueError(f"the corpus has no {by}")
    return ids
