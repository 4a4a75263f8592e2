"""Queries over text formats: each writes a table in a format to the shared folder, and reads it with its operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query, table
from weft.runtime import numbered, scratch
from weft.sources.files import Store, matching_lines, read_edges, read_fields, read_id_lists, read_log, read_number, read_tagged, write_frame


def graph_info(spark: SparkSession, path: str) -> DataFrame:
    """One row for a graph's folder: partitions, edge_los, and how many ids its files of nodes, read sets and write sets have.

    The folder has the numbers num_partitions and num_edge_los, and id lists in nodes, edge_read_sets and
    edge_write_sets.
    """
    numbers = [F.lit(read_number(spark, f"{path}/{n}")).cast("long").alias(n.removeprefix("num_")) for n in ("num_partitions", "num_edge_los")]
    out = None
    for name in ("nodes", "edge_read_sets", "edge_write_sets"):
        n = read_id_lists(spark, f"{path}/{name}").agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.crossJoin(n)  # of one row each
    return out.select(*numbers, "nodes", "edge_read_sets", "edge_write_sets")


def read_tsv_graph(spark: SparkSession, articles: str, links: str) -> DataFrame:
    """(src, dst) of a graph of named articles: lines of names, and of two names with a tab between. Empty lines and those from # on are none; ids are the places of names in their order; links of unknown names go."""
    lines = lambda path: spark.read.text(path).where("trim(value) != '' and value not like '#%'")
    ids = numbered(lines(articles).select(F.trim("value").alias("name")).distinct(), ["name"], "id")
    pairs = lines(links).select(F.split("value", "\t").alias("f")).select(F.trim(F.get("f", F.lit(0))).alias("a"), F.trim(F.get("f", F.lit(1))).alias("b"))
    for name, end in (("a", "src"), ("b", "dst")):
        pairs = pairs.join(ids.select(F.col("name").alias(name), F.col("id").alias(end)), name)
    return pairs.select("src", "dst")


def dump_ranks(ranks: DataFrame, path: str) -> None:
    """Lines `id rank` of ranks (id, rank), as many files as ranks has partitions."""
    ranks.select(F.format_string("%d %.10f", "id", "rank")).write.mode("overwrite").text(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, rank double").option("sep", " ").csv(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(name, domain, parts, ghost, flags) of lines `name : (x,y,z), (x,y,z), (x,y,z) : flags`; lines from # on are comments."""
    rows = spark.read.text(path).where("trim(value) != '' and value not like '#%'").select(F.split("value", r"\s*:\s*").alias("f"))
    numbers = F.transform(F.regexp_extract_all(F.get("f", F.lit(1)), F.lit(r"-?[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    return rows.select(F.trim(F.get("f", F.lit(0))).alias("name"), F.slice(numbers, 1, 3).alias("domain"), F.slice(numbers, 4, 3).alias("parts"), F.slice(numbers, 7, 3).alias("ghost"), F.split(F.trim(F.get("f", F.lit(2))), r"\s*,\s*").alias("flags"))


def read_by_rank(spark: SparkSession, path: str, template: str) -> DataFrame:
    """(rank, value): the lines of all files below a folder whose path ends as the template says, with the number that stands in place of {}."""
    before, after = template.split("{}")
    escape = lambda s: "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in s)
    rank = F.regexp_extract(F.col("_metadata.file_path"), f"{escape(before)}([0-9]+){escape(after)}", 1)
    return spark.read.option("recursiveFileLookup", "true").text(path).select(rank.alias("rank"), "value").where("rank != ''").withColumn("rank", F.col("rank").cast("int"))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def parse_command(text: Column) -> Column:
    """(name, parameters, sets) of a command `name parameter ...`: blanks separate, and sets says which parameters are sets, in braces."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.struct(F.get(parts, F.lit(0)).alias("name"), rest.alias("parameters"), F.transform(rest, lambda x: x.startswith("{") & x.endswith("}")).alias("sets"))


def data_header(text: Column) -> Column:
    """(worker, job, data, version, size) of a header of five numbers; a missing one is null."""
    f = F.split(F.trim(text), r"\s+")
    return F.struct(*(F.get(f, F.lit(i)).try_cast("long").alias(n) for i, n in enumerate(("worker", "job", "data", "version", "size"))))


def _written(lines: DataFrame, name: str, spark: SparkSession) -> str:
    path = scratch(spark, name)
    lines.write.text(path)
    return path


def _lists(df: DataFrame, part: Column, id_: Column) -> DataFrame:
    rows = df.groupBy(part.alias("p")).agg(F.sort_array(F.collect_list(id_.cast("long"))).alias("ids"))
    return rows.select(F.concat(F.col("p").cast("string"), F.lit(" : "), F.size("ids").cast("string"), F.lit(" : "), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")))


@query("s1_graph_info", "SELECT 10::BIGINT AS partitions, 100::BIGINT AS edge_los, (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM orders) AS edge_read_sets, (SELECT count(*) FROM supplier) AS edge_write_sets")
def _info(spark, d):
    path = scratch(spark, "graph")
    c, o, s = (table(spark, d, t) for t in ("customer", "orders", "supplier"))
    for name, df, key in (("nodes", c, "c_custkey"), ("edge_read_sets", o, "o_orderkey"), ("edge_write_sets", s, "s_suppkey")):
        _lists(df, F.col(key) % 10, F.col(key)).write.text(f"{path}/{name}")
    for name, n in (("num_partitions", "10"), ("num_edge_los", "100")):
        spark.range(1).select(F.lit(n)).write.text(f"{path}/{name}")
    return graph_info(spark, path)


@query("s2_node_partitions", "SELECT c_custkey % 10 AS part, (row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY c_custkey) - 1)::INT AS position, c_custkey AS id FROM customer")
def _nodes(spark, d):
    return read_id_lists(spark, _written(_lists(table(spark, d, "customer"), F.col("c_custkey") % 10, F.col("c_custkey")), "nodes", spark))


@query("s3_edge_sets", "SELECT o_custkey % 7 AS part, o_orderkey AS lo FROM orders")
def _sets(spark, d):
    return read_id_lists(spark, _written(_lists(table(spark, d, "orders"), F.col("o_custkey") % 7, F.col("o_orderkey")), "sets", spark)).select("part", F.col("id").alias("lo"))


@query("s4_number_files", "SELECT count(*) AS nodes FROM customer")
def _number(spark, d):
    path = _written(table(spark, d, "customer").agg(F.count(F.lit(1)).cast("string")), "number", spark)
    return spark.range(1).select(F.lit(read_number(spark, path)).cast("long").alias("nodes"))


@query("s5_edge_lines", "SELECT o_custkey AS src, o_orderkey AS dst FROM orders")
def _edges(spark, d):
    return read_edges(spark, _written(table(spark, d, "orders").select(F.concat_ws(" ", "o_custkey", "o_orderkey")), "edges", spark))


@query("s7_matching_lines", "SELECT 'INSERT INTO page VALUES (' || page_id || ')' AS value FROM pages WHERE page_id % 3 = 0")
def _matching(spark, d):
    k = F.col("page_id")
    line = F.when(k % 3 == 0, F.format_string("INSERT INTO page VALUES (%d)", k)).otherwise(F.format_string("-- page %d", k))
    return matching_lines(spark, _written(table(spark, d, "pages").select(line), "dump", spark), "INSERT")


@query("s8_named_links", "WITH n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region)) SELECT a.id AS src, b.id AS dst FROM nation JOIN region ON r_regionkey = n_regionkey JOIN n a ON a.name = n_name JOIN n b ON b.name = r_name")
def _named(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    names = n.select("n_name").union(r.select("r_name")).union(spark.range(1).select(F.lit("# names")))
    links = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("\t", "n_name", "r_name"))
    return read_tsv_graph(spark, _written(names, "articles", spark), _written(links, "links", spark))


@query("s9_rank_dump", "SELECT c_custkey AS id, (c_custkey % 1024) / 1024.0::DOUBLE AS rank FROM customer")
def _dump(spark, d):
    path = scratch(spark, "ranks")
    dump_ranks(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 1024 / 1024.0).alias("rank")), path)
    return read_ranks(spark, path)


@query("s10_frames", "SELECT p_partkey, p_size, 1 AS frame FROM part UNION ALL SELECT p_partkey, p_size + 1, 2 FROM part WHERE p_partkey % 2 = 0")
def _frames(spark, d):
    """Two frames, of which the second is written twice."""
    path, p = scratch(spark, "frames"), table(spark, d, "part").select("p_partkey", "p_size")
    write_frame(p, path, 1)
    write_frame(p, path, 2)
    write_frame(p.where("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 1), path, 2)
    return spark.read.parquet(path)


@query("s11_field_config", "SELECT 'DataFaceArray' AS class, n_name AS name, [40, 40, n_nationkey] AS domain, [2, 2, 1] AS parts, [3, 3, 3] AS ghost, ['none'] AS flags FROM nation")
def _fields(spark, d):
    lines = table(spark, d, "nation").select(F.format_string("DataFaceArray : %s : (40,40,%d), (2,2,1), (3,3,3) : none", "n_name", "n_nationkey"))
    return read_fields(spark, _written(lines, "fields", spark))


@query("s12_region_config", "SELECT 'Reg' || n_nationkey AS name, [40, 40, 40] AS domain, [n_nationkey % 3 + 1, 2, 1] AS parts, [3, 3, n_nationkey] AS ghost, ['central', 'outer', 'inner'] AS flags FROM nation")
def _regions(spark, d):
    k = F.col("n_nationkey")
    lines = table(spark, d, "nation").select(F.format_string("Reg%d  : (40, 40, 40), (%d, 2, 1), (3, 3, %d) : central, outer, inner", k, k % 3 + 1, k))
    return read_regions(spark, _written(lines.union(spark.range(1).select(F.lit("# flags"))), "regions", spark))


@query("s14_tagged_numbers", "SELECT event_type AS kind, sum((value::DECIMAL(18, 4)))::DOUBLE AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _tagged(spark, d):
    lines = table(spark, d, "events").select(F.concat("event_type", F.lit(": "), F.col("value").cast("decimal(18,4)").cast("string")))
    path = _written(lines, "tagged", spark)
    return read_tagged(spark, path, "click").agg(F.lit("click").alias("kind"), F.sum("value").cast("double").alias("total")).union(read_tagged(spark, path, "view").agg(F.lit("view"), F.sum("value").cast("double")))


@query("s15_files_by_rank", "SELECT (user_id % 5)::INT AS rank, event_id FROM events")
def _by_rank(spark, d):
    path = scratch(spark, "ranked")
    table(spark, d, "events").select((F.col("user_id") % 5).alias("rank"), F.concat(F.lit("ev "), F.col("event_id").cast("string")).alias("value")).write.partitionBy("rank").text(path)
    return read_by_rank(spark, path, "rank={}/").select("rank", F.regexp_extract("value", "([0-9]+)", 1).cast("long").alias("event_id"))


@query("s13_log_fields", "SELECT event_id AS job, event_type AS event, round(value, 3) AS seconds FROM events")
def _log_fields(spark, d):
    lines = table(spark, d, "events").select(F.format_string("a b c d e %s g h i %.6f k %d", "event_type", "value", "event_id"))
    return read_log(spark, _written(lines, "log", spark), {"event": (5, "string"), "seconds": (9, "double"), "job": (11, "long")}).select("job", "event", F.round("seconds", 3).alias("seconds"))


@query("s18_store", "SELECT 'k' || lpad(o_orderkey::VARCHAR, 9, '0') AS key, o_totalprice AS value FROM orders WHERE o_orderkey BETWEEN 100 AND 1999")
def _store(spark, d):
    """Values put under a checkpoint's number, by its handle, and a range of keys got back."""
    store = Store(spark, scratch(spark, "store"))
    store.put(table(spark, d, "orders").select(F.format_string("k%09d", "o_orderkey").alias("key"), F.col("o_totalprice").alias("value")), 3)
    return store.get(3, "k000000100", "k000002000")


@query("s21_sorted_table", "SELECT count(*) AS n, 0::BIGINT AS unordered, 0::BIGINT AS overlapping FROM orders")
def _sorted(spark, d):
    """A table built in key order: within a file no key comes before a smaller one, and no two files overlap."""
    from pyspark.sql.window import Window as W

    store = Store(spark, scratch(spark, "table"))
    rows = store.load(store.put(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value")), 1))
    rows = rows.select("key", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("key").over(W.partitionBy("file").orderBy("at"))
    per = rows.withColumn("wrong", before > F.col("key")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("unordered"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    per = per.withColumn("last", F.lag("hi").over(W.orderBy("lo")))  # a row for each file
    return per.agg(F.sum("n").alias("n"), F.sum("unordered").alias("unordered"), F.count_if(F.col("last") >= F.col("lo")).alias("overlapping"))


@query("s24_initial_values", "SELECT p_partkey, 1.0::DOUBLE AS one, ('0x' || md5(p_partkey || ':9')[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS random FROM part")
def _initial(spark, d):
    from weft.functions.numeric import uniform

    return table(spark, d, "part").select("p_partkey", F.lit(1.0).alias("one"), uniform(F.col("p_partkey"), 9).alias("random"))


@query("s25_initial_partitions", "SELECT part, list(k ORDER BY k) AS cells, len(list(k)) AS n FROM (SELECT p_partkey AS k, p_partkey // 64 AS part FROM part) GROUP BY 1")
def _partitions(spark, d):
    rows = table(spark, d, "part").groupBy(F.expr("p_partkey div 64").alias("part")).agg(F.sort_array(F.collect_list("p_partkey")).alias("cells"))
    return rows.withColumn("n", F.size("cells").cast("long"))


@query("o8_lines_by_first_number", "SELECT row_number() OVER (ORDER BY value, event_id) - 1 AS place, event_id FROM events")
def _by_number(spark, d):
    lines = table(spark, d, "events").select("event_id", F.concat(F.lit("at "), F.col("value").cast("string"), F.lit(" of 7")).alias("line"))
    return numbered(lines.withColumn("number", first_number(F.col("line"))), ["number", "event_id"], "place").select("place", "event_id")


@query("f5_commands", "SELECT o_orderkey, 'spawn' AS name, ['j' || o_custkey, '{' || o_orderkey || ',7}', 'x'] AS parameters, [false, true, false] AS sets FROM orders")
def _commands(spark, d):
    text = F.format_string("  spawn j%d  {%d,7} x ", "o_custkey", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", parse_command(text).alias("c")).select("o_orderkey", "c.*")


@query("f6_data_header", "SELECT o_orderkey, o_custkey AS worker, o_orderkey AS job, 7::BIGINT AS data, NULL::BIGINT AS version, 12::BIGINT AS size FROM orders")
def _header(spark, d):
    text = F.format_string("%d %d 7 x 12", "o_custkey", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", data_header(text).alias("h")).select("o_orderkey", "h.*")


@query("f7_numbers_as_text", "SELECT o_orderkey, o_custkey::VARCHAR AS text FROM orders")
def _as_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("text"))


@query("f9_short_numbers", "SELECT event_id, format('{:.1e}', value * 1.00037) AS shown FROM events")
def _short(spark, d):
    """Two digits and an exponent. Halves go up by their decimal digits, so numbers with more digits are shown."""
    return table(spark, d, "events").select("event_id", F.format_string("%.1e", F.col("value") * 1.00037).alias("shown"))
