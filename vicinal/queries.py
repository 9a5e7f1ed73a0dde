"""The engine's queries over the test tables, and the same in SQL.

Points are the embeddings: id vec_id, vector embedding, and for queries over several documents
doc_id label. The query point is the vector of vec_id 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import denormalize, explode_components, extent, from_json_array, l2, level, linf, normalization, normalize, vector_text
from .operators.grid import GridIndex
from .operators.stored_index import StoredIndex
from .operators.tree_build import build_index, range_values, split_levels
from .operators.tree_search import leaf_paths, range_search, range_search_batch, register_search, search, search_batch, search_sql
from .plans.catalog import VectorCatalog
from .plans.schemas import as_points
from .plans.storage import materialize, scratch_path
from .sources.files import read_arff, read_vectors, write_range_values, write_vectors
from .sources.generators import lattice, one_hot, random_uniform

DOMAIN, RADIUS = 0.1, 1.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str, by_label: bool = False) -> DataFrame:
    return as_points(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label" if by_label else None)


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def _ids(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "text_id")


# statistics of dimensions and splits


def dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = explode_components(_points(spark, sf_dir))
    return parts.groupBy("idx").agg(
        F.round(F.avg("value"), 5).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 5).alias("stdev"), F.count("*").alias("n"),
        F.expr("cast(sum(cast(id as decimal(38, 0))) div count(*) as bigint)").alias("mean_id"),
    )


def _levels(spark: SparkSession, sf_dir: str, depth: int, mode: str = "sql") -> DataFrame:
    return split_levels(_points(spark, sf_dir), mode, depth + 1).where(level(F.col("range_id")) == depth)


def root_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, 0).select("dimension", F.round(F.col("mid").cast("double"), 5).alias("mid"), F.round("stdev", 5).alias("stdev"), F.col("points").alias("n"), "mean_id")


def root_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    split = F.broadcast(_levels(spark, sf_dir, 0).select("dimension", "mid", "stdev", "mean_id"))  # one row
    value = F.get("vector", "dimension")
    high = F.when(F.col("stdev") == 0, F.col("id") > F.col("mean_id")).otherwise(value >= F.col("mid"))
    return points.join(split, F.lit(True)).select("id", (high.cast("int") + 1).alias("range_id"))


def level1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, 1).select("range_id", "dimension", F.round(F.col("mid").cast("double"), 5).alias("mid"), F.col("points").alias("n"))


# trees


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", "range_id", "dimension", F.round(F.col("mid").cast("double"), 5).alias("mid"), "low_range_id", "high_range_id", "id")


def tree_nodes_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(build_index(_points(spark, sf_dir), "sql"))


def tree_nodes_alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(build_index(_points(spark, sf_dir), "alternate"))


def tree_nodes_level_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree by the distributed level loop down to ranges of 50 points."""
    return _nodes(build_index(_points(spark, sf_dir), "sql", cutoff=50))


def tree_nodes_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(build_index(_points(spark, sf_dir, True), "sql"))


def tree_range_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = range_values(build_index(_points(spark, sf_dir), "alternate", statistics=True))
    return values.select("range_id", "dimension", F.round(F.col("mid").cast("double"), 5).alias("mid"), "id")


def tree_level_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = build_index(_points(spark, sf_dir), "sql")
    return nodes.groupBy(level(F.col("range_id")).alias("level")).agg(F.count("*").alias("nodes"), F.count("id").alias("leaves"))


def leaf_path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = leaf_paths(build_index(_points(spark, sf_dir), "sql"))
    steps = paths.select("id", F.posexplode("path").alias("step", "c"))
    return steps.select("id", "step", "c.dimension", F.round(F.col("c.mid").cast("double"), 5).alias("mid"), "c.is_high")


# candidates of a box


def box_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = leaf_paths(build_index(_points(spark, sf_dir), "sql"))
    return _ids(search(paths, _query(spark, sf_dir), DOMAIN))


def box_candidates_alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = leaf_paths(build_index(_points(spark, sf_dir), "alternate"))
    return _ids(search(paths, _query(spark, sf_dir), DOMAIN))


def box_candidates_all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = leaf_paths(build_index(_points(spark, sf_dir, True), "sql"))
    return _ids(search(paths, _query(spark, sf_dir), DOMAIN))


def box_candidates_one_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = leaf_paths(build_index(_points(spark, sf_dir, True).where("doc_id = 3"), "sql"))
    return _ids(search(paths, _query(spark, sf_dir), DOMAIN, 3))


def box_candidates_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query point as a JSON array."""
    q = _table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.to_json("embedding")).first()[0]
    return _ids(search(leaf_paths(build_index(_points(spark, sf_dir), "sql")), q, DOMAIN))


def box_candidates_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search as a table function of SQL."""
    paths = materialize(leaf_paths(build_index(_points(spark, sf_dir), "sql")), "query-paths")
    register_search(spark, paths)
    q = _table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.to_json("embedding")).first()[0]
    return spark.sql(f"select doc_id, text_id from vicinity_search('{q}', {DOMAIN}f, null)")


def _stored(spark: SparkSession, sf_dir: str, by_label: bool = False) -> StoredIndex:
    """An index on disk with tops of about 64 points, since the test tables are small."""
    return StoredIndex.write(_points(spark, sf_dir, by_label), scratch_path(spark, "stored"), top_points=64)


def box_candidates_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(_stored(spark, sf_dir).search(_query(spark, sf_dir), DOMAIN))


def box_candidates_stored_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(_stored(spark, sf_dir, True).search(_query(spark, sf_dir), DOMAIN))


def box_candidates_recursive_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialize(build_index(_points(spark, sf_dir), "sql"), "query-index")
    return _ids(search_sql(spark, index, _query(spark, sf_dir), DOMAIN))


def _queries(spark: SparkSession, sf_dir: str, domain: float) -> DataFrame:
    asked = _table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(float(domain)).alias("domain"), F.lit(None).cast("long").alias("doc_id"))


def box_candidates_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialize(build_index(_points(spark, sf_dir), "sql"), "query-index")
    return search_batch(index, _queries(spark, sf_dir, DOMAIN)).select("query_id", "text_id")


def search_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialize(build_index(_points(spark, sf_dir), "sql"), "query-index")
    visits = search_batch(index, _queries(spark, sf_dir, DOMAIN), with_visits=True)
    return visits.groupBy("query_id").agg(F.count("*").alias("visited"), F.count("text_id").alias("candidates"))


# exact ranges


def linf_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    found = range_search(leaf_paths(build_index(points, "sql")), points, _query(spark, sf_dir), 0.3, "linf")
    return found.select("text_id", F.round("distance", 5).alias("distance"))


def l2_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    found = range_search(leaf_paths(build_index(points, "sql")), points, _query(spark, sf_dir), RADIUS)
    return found.select("text_id", F.round("distance", 5).alias("distance"))


def l2_range_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read from disk: the leaves that the box reaches, which have their vectors."""
    found = _stored(spark, sf_dir).range_search(_query(spark, sf_dir), RADIUS)
    return found.select("text_id", F.round("distance", 5).alias("distance"))


def l2_range_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    index = materialize(build_index(points, "sql"), "query-index")
    return range_search_batch(index, points, _queries(spark, sf_dir, RADIUS)).select("query_id", "text_id", F.round("distance", 5).alias("distance"))


def l2_range_join_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    found = range_search(leaf_paths(build_index(points, "sql")), points, _query(spark, sf_dir), RADIUS)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang").withColumnRenamed("doc_id", "d")
    return found.join(docs, F.col("text_id") == F.col("d")).select("text_id", "source", "lang", F.round("distance", 5).alias("distance"))


# scaling


def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("float"), F.col("p_retailprice").cast("float")).alias("vector"))
    offsets, scale = normalization(*extent(parts))
    v = normalize("vector", offsets, scale)
    return parts.select("p_partkey", F.round(F.get(v, F.lit(0)).cast("double"), 5).alias("x"), F.round(F.get(v, F.lit(1)).cast("double"), 5).alias("y"))


def denormalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("float"), F.col("p_retailprice").cast("float")).alias("vector"))
    offsets, scale = normalization(*extent(parts))
    v = denormalize(normalize("vector", offsets, scale), offsets, scale)
    return parts.select("p_partkey", F.round(F.get(v, F.lit(0)).cast("double"), 1).alias("x"), F.round(F.get(v, F.lit(1)).cast("double"), 1).alias("y"))


# the grid


def _grid(spark: SparkSession, sf_dir: str, **options) -> GridIndex:
    return GridIndex(_table(spark, sf_dir, "embeddings"), "embedding", **options)


def grid_sign_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first halving of each dimension, as a string."""
    key = F.concat_ws("", F.transform("embedding", lambda x: F.when(x < 0, "0").otherwise("1")))
    return _table(spark, sf_dir, "embeddings").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def grid_leaf_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).cells().where("records is not null").select("cell", "records")


def grid_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _query(spark, sf_dir)
    return _grid(spark, sf_dir).find(q, RADIUS, l2("embedding", q) <= RADIUS).select("vec_id", "label")


def grid_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _query(spark, sf_dir)
    return _grid(spark, sf_dir).remove(q, RADIUS, l2("embedding", q) <= RADIUS).records().select("vec_id", "label")


def grid_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return GridIndex(rows.where("label < 5"), "embedding").add(rows.where("label >= 5")).cells().where("records is not null").select("cell", "records")


def grid_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).records().select("vec_id", "label")


def grid_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _grid(spark, sf_dir)
    return spark.range(1).select(F.lit(grid.count).cast("long").alias("n"), F.lit(grid.clear().count).cast("long").alias("n_cleared"))


def grid_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the grid with its parent, its records' ids and the sums of its centre's components."""
    cells = _grid(spark, sf_dir).cells("vec_id")
    centre = F.aggregate(F.transform("center", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return cells.select("cell", "parent", "records", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), F.round(centre, 6).alias("centre"))


def grid_part_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid over two normalised columns; the records within 0.2 of the centre."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("float"), F.col("p_retailprice").cast("float")).alias("raw"))
    offsets, scale = normalization(*extent(parts, "raw"))
    rows = parts.withColumn("vector", normalize("raw", offsets, scale))
    return GridIndex(rows).find([0.0, 0.0], 0.2, l2("vector", [0.0, 0.0]) <= 0.2).select("p_partkey")


# formats and maintenance


def json_vector_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("["), vector_text("embedding"), F.lit("]"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", from_json_array(text).alias("v"), "embedding").select("vec_id", F.size("v").alias("n"), (F.col("v") == F.col("embedding")).alias("same"))


def _lines(spark: SparkSession, path: str, header: str) -> DataFrame:
    """The lines of a file that a sink has written, without its header."""
    return spark.read.text(path).where(F.col("value") != header)


def vector_csv_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the vector sink, components as thousandths."""
    path = scratch_path(spark, "vectors")
    write_vectors(_points(spark, sf_dir), path)
    parts = _lines(spark, path, "ID|Vector").select(F.split("value", r"\|").alias("p"))
    whole = F.transform(F.split(F.col("p")[1], ","), lambda x: F.round(x.cast("float").cast("double") * 1000).cast("long").cast("string"))
    return parts.select(F.col("p")[0].cast("long").alias("vec_id"), F.concat_ws("|", F.col("p")[0], F.concat_ws(",", whole)).alias("line"))


def vector_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written and read again are the same."""
    path = scratch_path(spark, "vectors")
    points = _points(spark, sf_dir)
    write_vectors(points, path)
    back = read_vectors(spark, path).select(F.col("id").alias("i"), F.col("vector").alias("v"))
    return points.join(back, F.col("id") == F.col("i")).select(F.col("id").alias("vec_id"), F.size("v").alias("n"), (F.col("v") == F.col("vector")).alias("same"))


def index_csv_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the index sink, read from its lines."""
    path = scratch_path(spark, "values")
    write_range_values(range_values(build_index(_points(spark, sf_dir), "alternate", statistics=True)), path)
    p = F.split("value", ",")
    return _lines(spark, path, "RangeID,Dimension,Mid,ID").select(p[0].cast("long").alias("range_id"), p[1].cast("int").alias("dimension"), F.round(p[2].cast("float").cast("double"), 5).alias("mid"), p[3].cast("long").alias("id"))


def arff_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as an ARFF file of two numbers and a class, written and read."""
    path = scratch_path(spark, "arff")
    head = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in ("% nations", "@relation nation", "@attribute key numeric", "@attribute region numeric", "@attribute class string", "", "@DATA")))).alias("value"), F.lit(-1).alias("o"))
    rows = _table(spark, sf_dir, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), (F.col("n_regionkey") + 0.5).cast("string"), "n_name").alias("value"), F.col("n_nationkey").cast("int").alias("o"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return read_arff(spark, path).select("id", "tag", F.col("vector")[0].cast("double").alias("x"), F.col("vector")[1].cast("double").alias("y"))


def generated_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_components(random_uniform(spark, 200, 16, 5)).select("id", "idx", F.col("value").cast("double").alias("value"))


def generated_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_components(one_hot(spark, 24)).select("id", "idx", F.col("value").cast("double").alias("value"))


def generated_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lattice(spark, 20, 9.5, 10)
    return rows.select("id", "tag", F.round(F.col("vector")[0].cast("double"), 5).alias("x"), F.round(F.col("vector")[1].cast("double"), 5).alias("y"))


def _catalog(spark: SparkSession, sf_dir: str, index: bool = True) -> VectorCatalog:
    catalog = VectorCatalog(spark, scratch_path(spark, "catalog"), buckets=4)
    rows = _table(spark, sf_dir, "embeddings")
    catalog.add_texts(rows.select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("text_id"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("["), vector_text("embedding"), F.lit("]")).alias("vector")))
    if index:
        catalog.index_documents()
    return catalog


def reindex_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document 3 gets its vectors again under new ids, and is indexed anew."""
    catalog = _catalog(spark, sf_dir)
    again = catalog.texts().where("doc_id = 3").withColumn("text_id", F.col("text_id") + 1_000_000)
    catalog.add_texts(materialize(again, "query-texts"))
    catalog.index_document(3)
    return catalog.index().where("id is not null").groupBy("doc_id").agg(F.count("*").alias("leaves"), F.max("id").alias("last_id"))


def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    catalog.delete_document(3)
    return catalog.index().where("id is not null").select("doc_id", F.col("id").alias("text_id"))


def next_text_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir, index=False)
    return spark.range(1).select(F.lit(catalog.next_ids()).cast("long").alias("next_id"))


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, texts and leaves by document, after one was renamed and one deleted."""
    catalog = _catalog(spark, sf_dir)
    catalog.add_documents(catalog.texts().select("doc_id").distinct().select("doc_id", F.concat(F.lit("document "), F.col("doc_id")).alias("name")))
    catalog.add_documents(spark.createDataFrame([(1, "first")], "doc_id long, name string"))
    catalog.delete_document(2)
    texts = catalog.texts().groupBy(F.col("doc_id").alias("t")).agg(F.count("*").alias("texts"))
    leaves = catalog.index().where("id is not null").groupBy(F.col("doc_id").alias("l")).agg(F.count("*").alias("leaves"))
    docs = catalog.documents()
    return docs.join(texts, F.col("doc_id") == F.col("t")).join(leaves, F.col("doc_id") == F.col("l")).select("doc_id", "name", "texts", "leaves")


def unmatched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a brute-force range that the index's range lacks, and others: none of the former."""
    q = _query(spark, sf_dir)
    rows = _table(spark, sf_dir, "embeddings")
    found = _grid(spark, sf_dir).find(q, RADIUS, l2("embedding", q) <= RADIUS)
    return rows.join(found.select("vec_id"), "vec_id", "left_anti").select("vec_id", (linf("embedding", q) <= 0.3).alias("in_box"))


QUERIES = (
    dimension_stats, root_split, root_assignment, level1_splits, tree_nodes_sql, tree_nodes_alternate, tree_nodes_level_by_level, tree_nodes_by_document, tree_range_values, tree_level_profile, leaf_path_steps,
    box_candidates, box_candidates_alternate, box_candidates_all_docs, box_candidates_one_doc, box_candidates_recursive_sql, box_candidates_batch, search_efficiency,
    linf_range, l2_range, l2_range_batch, l2_range_join_documents, normalize_vectors, denormalize_vectors,
    grid_sign_cells, grid_leaf_cells, grid_find, grid_remove, grid_add, grid_enumerate, grid_count, grid_part_prices,
    json_vector_roundtrip, vector_csv_format, reindex_document, delete_document, unmatched_records,
    box_candidates_json, box_candidates_sql_function, box_candidates_stored, box_candidates_stored_by_document, l2_range_stored, grid_hierarchy,
    vector_csv_roundtrip, index_csv_format, arff_vectors, generated_uniform, generated_one_hot, generated_lattice, next_text_id, catalog_tables,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


# SQL


def _tree(mode: str = "sql", doc: str = "0") -> str:
    """Common tables: assigned (doc, lvl, rid, id), the points of each node, and node, the tree."""
    least = "lvl = 1" if mode == "sql" else "lvl % 2 = 1"
    root = "when b.lvl = 0 and b.sd > 1e-12 then 2" if mode == "sql" else ""
    shown = "sd > 1e-12" if mode == "sql" else "true"
    stats = f"""select doc, lvl, rid, i, avg(v)::float as m, coalesce(stddev_samp(v), 0) as sd, count(*) as c, (sum(id) // count(*))::bigint as mid from {{}} group by doc, lvl, rid, i"""
    best = f"""select * from {{}} {{}} qualify row_number() over (partition by doc, rid order by case when {least} then round(sd, 7) else -round(sd, 7) end, i) = 1"""
    return f"""
with recursive points as (select vec_id as id, ({doc})::bigint as doc, embedding from embeddings),
assigned(doc, lvl, rid, id) as (
  select doc, 0, 0::bigint, id from points
  union all
  (with x as (select r.doc, r.lvl, r.rid, r.id, unnest(range(len(e.embedding))) as i, unnest(e.embedding) as v
              from assigned r join points e on e.id = r.id and e.doc = r.doc),
        s as ({stats.format("x")}),
        b as ({best.format("s", "where c > 1")})
   select x.doc, x.lvl + 1, x.rid * 2 + case when x.v < b.m then 1 when x.v > b.m then 2 {root} when x.id <= b.mid then 1 else 2 end, x.id
   from x join b on b.doc = x.doc and b.rid = x.rid and b.i = x.i)),
y as (select r.doc, r.lvl, r.rid, r.id, unnest(range(len(e.embedding))) as i, unnest(e.embedding) as v from assigned r join points e on e.id = r.id and e.doc = r.doc),
t as ({stats.format("y")}),
chosen as ({best.format("t", "")}),
node as (
  select doc, lvl, rid, c, sd, mid, case when c > 1 and {shown} then i end::integer as dimension, case when c > 1 and {shown} then m end as m,
         case when c > 1 then rid * 2 + 1 end as lo, case when c > 1 then rid * 2 + 2 end as hi, case when c = 1 then mid end as id
  from chosen)"""


NODES_SQL = "\nselect doc as doc_id, rid as range_id, dimension, round(m::double, 5) as mid, lo as low_range_id, hi as high_range_id, id from node"


def _search(domain: float, queries: str = "vec_id = 0", only: str = "true") -> str:
    """Further common tables: asked (qid, q), and reached (qid, doc, rid, id, ...), the nodes visited."""
    return f""",
asked as (select vec_id as qid, embedding as q from embeddings where {queries}),
reached(qid, doc, rid) as (
  select a.qid, n.doc, n.rid from asked a cross join node n where n.rid = 0 and {only}
  union all
  select w.qid, n.doc, n.rid
  from reached w join node p on p.doc = w.doc and p.rid = w.rid join asked a on a.qid = w.qid
  join node n on n.doc = p.doc and ((n.rid = p.lo and (p.dimension is null or p.m >= a.q[p.dimension + 1] - {domain}::float))
                                 or (n.rid = p.hi and (p.dimension is null or p.m <= a.q[p.dimension + 1] + {domain}::float))))"""


CANDIDATES_SQL = "\nselect w.doc as doc_id, n.id as text_id from reached w join node n on n.doc = w.doc and n.rid = w.rid where n.id is not null"
Q0 = "(select embedding from embeddings where vec_id = 0)"
DISTANCE = "list_distance(a.embedding::double[], b.embedding::double[])"
LINF = "list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::double - z[2]::double)))"

_PART = """
with v as (select p_partkey, p_size::float as a, p_retailprice::float as b from part),
e as (select min(a)::double as la, max(a)::double as ha, min(b)::double as lb, max(b)::double as hb from v),
k as (select case when least(la, lb) >= -1 and greatest(ha, hb) <= 1 then 0 else (la + ha) / 2 end as oa, case when least(la, lb) >= -1 and greatest(ha, hb) <= 1 then 0 else (lb + hb) / 2 end as ob,
             case when (least(la, lb) >= -1 and greatest(ha, hb) <= 1) or greatest(ha - la, hb - lb) <= 2 then 1 else greatest(ha - la, hb - lb) / 2 end as s from e),
n as (select p_partkey, ((a::double - oa) / s)::float as x, ((b::double - ob) / s)::float as y, oa, ob, s from v cross join k)
"""

#: A cell is the shortest run of halvings that at most ten vectors share; 64 dimensions, depths 0 and 1 suffice for the test tables.
_CELLS = """
with place as (select vec_id, list_transform(embedding, lambda x: greatest(0, least(16777215, floor((x::double + 1) * 8388608)::bigint))) as p from embeddings),
code as (select vec_id, list_aggregate(list_transform(range(256), lambda k: ((p[k % 64 + 1] >> (23 - k // 64)) & 1)::varchar), 'string_agg', '') as c from place),
runs as (select vec_id, c, unnest(range(0, 257)) as k from code),
counted as (select vec_id, k, substr(c, 1, k) as run, count(*) over (partition by k, substr(c, 1, k)) as n from runs),
leaf as (select vec_id, min_by(run, k) as cell from counted where n <= 10 group by vec_id)
"""


def oracle_sql() -> dict[str, str]:
    tree, alternate, by_label = _tree(), _tree("alternate"), _tree(doc="label")
    near = f"from embeddings a cross join (select embedding from embeddings where vec_id = 0) b where {DISTANCE} <= {RADIUS}"
    cells = _CELLS + "select cell, count(*) as records from leaf group by cell"
    values = alternate + "\nselect rid as range_id, case when c = 1 then -1 else dimension end::integer as dimension, case when c = 1 then 0 else round(m::double, 5) end as mid, mid as id from node"
    p = 2_147_483_647
    step = "(h * h + h * 40692 % {p} + {c}) % {p}"
    h = f"(id * 48271 + idx * 69621 + {5 * 16_807 % p}) % {p}"
    return {
        "box_candidates_json": tree + _search(DOMAIN) + CANDIDATES_SQL,
        "box_candidates_sql_function": tree + _search(DOMAIN) + CANDIDATES_SQL,
        "box_candidates_stored": tree + _search(DOMAIN) + CANDIDATES_SQL,
        "box_candidates_stored_by_document": by_label + _search(DOMAIN) + CANDIDATES_SQL,
        "l2_range_stored": f"select a.vec_id as text_id, round({DISTANCE}, 5) as distance {near}",
        "grid_hierarchy": _CELLS
        + """,
cells as (select cell, count(*) as records, string_agg(vec_id::varchar, ',' order by vec_id) as ids from leaf group by cell),
inside as (select distinct substr(cell, 1, k) as cell from (select cell, unnest(range(0, len(cell))) as k from cells)),
nodes as (select cell, records, ids from cells union all select cell, null, '' from inside),
dims as (select cell, records, ids, unnest(range(64)) as i from nodes),
halved as (select *, (len(cell) + 63 - i) // 64 as n from dims),
placed as (select *, coalesce(list_sum(list_transform(range(n), lambda k: substr(cell, (k * 64 + i + 1)::integer, 1)::integer * (1 << (n - 1 - k)::integer))), 0) as loc from halved)
select cell, case when len(cell) > 0 then substr(cell, 1, len(cell) - 1) end as parent, any_value(records) as records, any_value(ids) as ids, round(sum((i + 1) * ((2 * loc + 1) / (1 << n::integer) - 1)), 6) as centre
from placed group by cell""",
        "vector_csv_roundtrip": "select vec_id, len(embedding)::integer as n, true as same from embeddings",
        "index_csv_format": values,
        "arff_vectors": "select row_number() over (order by n_nationkey) - 1 as id, n_name as tag, n_nationkey::double as x, n_regionkey + 0.5::double as y from nation",
        "generated_uniform": f"""with a as (select id, idx, {h} as h from range(200) r(id), range(16) s(idx)), b as (select id, idx, {step.format(p=p, c=1_234_567)} as h from a),
c as (select id, idx, {step.format(p=p, c=7_654_321)} as h from b), d as (select id, idx, {step.format(p=p, c=31_415_926)} as h from c)
select id, idx::integer as idx, ((h % 16777216) / 8388608.0::double - 1)::float::double as value from d""",
        "generated_one_hot": "select id, idx::integer as idx, case when id = idx then 1 else 0 end::double as value from range(24) r(id), range(24) s(idx)",
        "generated_lattice": "select i * 20 + j as id, i || ',' || j as tag, round(((i - 9.5) / 10)::float::double, 5) as x, round(((j - 9.5) / 10)::float::double, 5) as y from range(20) r(i), range(20) s(j)",
        "next_text_id": "select max(vec_id) + 1 as next_id from embeddings",
        "catalog_tables": "select label::bigint as doc_id, case when label = 1 then 'first' else 'document ' || label end as name, count(*) as texts, count(*) as leaves from embeddings where label <> 2 group by label",
        "dimension_stats": "select i::integer as idx, round(avg(v), 5) as mean, round(coalesce(stddev_samp(v), 0), 5) as stdev, count(*) as n, (sum(id) // count(*))::bigint as mean_id from (select vec_id as id, unnest(range(len(embedding))) as i, unnest(embedding) as v from embeddings) group by i",
        "root_split": tree + "\nselect dimension, round(m::double, 5) as mid, round(sd, 5) as stdev, c as n, mid as mean_id from node where rid = 0",
        "root_assignment": tree + "\nselect id, rid::integer as range_id from assigned where lvl = 1",
        "level1_splits": tree + "\nselect rid as range_id, dimension, round(m::double, 5) as mid, c as n from node where lvl = 1",
        "tree_nodes_sql": tree + NODES_SQL,
        "tree_nodes_alternate": alternate + NODES_SQL,
        "tree_nodes_level_by_level": tree + NODES_SQL,
        "tree_nodes_by_document": by_label + NODES_SQL,
        "tree_range_values": alternate + "\nselect rid as range_id, case when c = 1 then -1 else dimension end::integer as dimension, case when c = 1 then 0 else round(m::double, 5) end as mid, mid as id from node",
        "tree_level_profile": tree + "\nselect lvl as level, count(*) as nodes, count(id) as leaves from node group by lvl",
        "leaf_path_steps": tree
        + """,
walk as (select id, rid, 0 as step, rid as child from node where id is not null and rid > 0 union all select id, rid, step + 1, (child - 1) // 2 from walk where (child - 1) // 2 > 0)
select w.id, w.step::integer as step, n.dimension, round(n.m::double, 5) as mid, w.child % 2 = 0 as is_high from walk w join node n on n.rid = (w.child - 1) // 2""",
        "box_candidates": tree + _search(DOMAIN) + CANDIDATES_SQL,
        "box_candidates_alternate": alternate + _search(DOMAIN) + CANDIDATES_SQL,
        "box_candidates_all_docs": by_label + _search(DOMAIN) + CANDIDATES_SQL,
        "box_candidates_one_doc": by_label + _search(DOMAIN, only="n.doc = 3") + CANDIDATES_SQL,
        "box_candidates_recursive_sql": tree + _search(DOMAIN) + CANDIDATES_SQL,
        "box_candidates_batch": tree + _search(DOMAIN, "vec_id % 50 = 0") + "\nselect w.qid as query_id, n.id as text_id from reached w join node n on n.doc = w.doc and n.rid = w.rid where n.id is not null",
        "search_efficiency": tree + _search(DOMAIN, "vec_id % 50 = 0") + "\nselect w.qid as query_id, count(*) as visited, count(n.id) as candidates from reached w join node n on n.doc = w.doc and n.rid = w.rid group by w.qid",
        "linf_range": f"select a.vec_id as text_id, round({LINF}, 5) as distance from embeddings a cross join (select embedding from embeddings where vec_id = 0) b where {LINF} <= 0.3",
        "l2_range": f"select a.vec_id as text_id, round({DISTANCE}, 5) as distance {near}",
        "l2_range_batch": f"select b.vec_id as query_id, a.vec_id as text_id, round({DISTANCE}, 5) as distance from embeddings a join embeddings b on b.vec_id % 50 = 0 where {DISTANCE} <= {RADIUS}",
        "l2_range_join_documents": f"select text_id, source, lang, distance from (select a.vec_id as text_id, round({DISTANCE}, 5) as distance {near}) join documents on doc_id = text_id",
        "normalize_vectors": _PART + "select p_partkey, round(x::double, 5) as x, round(y::double, 5) as y from n",
        "denormalize_vectors": _PART + "select p_partkey, round((x::double * s + oa)::float::double, 1) as x, round((y::double * s + ob)::float::double, 1) as y from n",
        "grid_sign_cells": "select list_aggregate(list_transform(embedding, lambda x: case when x < 0 then '0' else '1' end), 'string_agg', '') as key, count(*) as n from embeddings group by 1",
        "grid_leaf_cells": cells,
        "grid_find": f"select a.vec_id, a.label {near}",
        "grid_remove": f"select a.vec_id, a.label from embeddings a cross join (select embedding from embeddings where vec_id = 0) b where not {DISTANCE} <= {RADIUS}",
        "grid_add": cells,
        "grid_enumerate": "select vec_id, label from embeddings",
        "grid_count": "select count(*) as n, 0::bigint as n_cleared from embeddings",
        "grid_part_prices": _PART + "select p_partkey from n where sqrt(x::double * x + y::double * y) <= 0.2",
        "json_vector_roundtrip": "select vec_id, len(embedding)::integer as n, (cast(to_json(embedding) as float[]) = embedding) as same from embeddings",
        "vector_csv_format": "select vec_id, vec_id::varchar || '|' || list_aggregate(list_transform(embedding, lambda x: round(x::double * 1000)::bigint::varchar), 'string_agg', ',') as line from embeddings",
        "reindex_document": "select label::bigint as doc_id, case when label = 3 then 2 else 1 end * count(*) as leaves, max(vec_id) + case when label = 3 then 1000000 else 0 end as last_id from embeddings group by label",
        "delete_document": "select label::bigint as doc_id, vec_id as text_id from embeddings where label <> 3",
        "unmatched_records": f"select a.vec_id, {LINF} <= 0.3 as in_box from embeddings a cross join (select embedding from embeddings where vec_id = 0) b where not {DISTANCE} <= {RADIUS}",
    }
