"""The driver's tables in the roles of the data model: products, sources, snapshots, files, chunks and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """Lazy role views over one folder of tables; each reads only the columns that a query uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def files(self) -> DataFrame:
        d, i = self.table("documents"), F.col("doc_id")
        domain = F.when(i % 5 == 1, "unknown").when(i % 5 == 2, "code").when(i % 5 == 3, "tests").when(i % 5 == 4, "architecture")
        return d.select(
            i.alias("id"), F.concat_ws("/", "source", "lang").alias("snapshot_id"), F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), i.cast("string"), F.lit(".txt")).alias("path"),
            F.col("n_chars").alias("size"), F.when(i % 7 == 0, "text/markdown").otherwise("text/plain").alias("content_type"), F.sha2("text", 256).alias("content_hash"),
            F.col("lang").alias("language"), domain.alias("domain"), i.alias("created_at"), F.col("text").alias("content"),
        )

    @property
    def snapshots(self) -> DataFrame:
        top = self.table("documents").groupBy("source", "lang").agg(F.max("doc_id").alias("created_at"))
        return top.select(
            F.concat_ws("/", "source", "lang").alias("id"), F.col("source").alias("source_id"), F.col("lang").alias("version_identifier"), (F.col("lang") != "de").alias("indexed"),
            F.when(F.col("lang") != "es", F.col("created_at")).alias("indexed_at"), "created_at",
        )

    @property
    def sources(self) -> DataFrame:
        number = F.substring("source", 4, 10).cast("int")
        rows = self.table("documents").select("source").distinct()
        return rows.select(F.col("source").alias("id"), (number % 3).alias("product_id"), F.col("source").alias("name"), F.when(number % 4 == 0, "local").otherwise("git").alias("source_type"), number.alias("created_at"))

    @property
    def products(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 100).alias("created_at"))

    @property
    def wiki(self) -> DataFrame:
        n = self.table("nation")
        return n.filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("product_id"), F.concat(F.lit("/wiki/"), F.col("n_name")).alias("output_path"), (F.col("n_nationkey") + 4).alias("generated_at"))

    @property
    def git_refs(self) -> DataFrame:
        s = self.snapshots
        return s.select(F.concat(F.lit("ref-"), F.col("id")).alias("id"), "source_id", F.col("version_identifier").alias("ref_name"), F.col("id").alias("snapshot_id"))

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("model"))

    @property
    def chunks(self) -> DataFrame:
        """Messages of conversations: several chunks a file."""
        c, e = self.table("conversations"), F.col("conv_id")
        return c.select(
            (e * 1000 + F.col("turn")).alias("id"), e.alias("file_id"), F.col("turn").alias("ordinal"), F.col("role").alias("chunk_type"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"),
            F.ceil(F.char_length("text") / 4).cast("int").alias("token_count"), F.when(F.col("turn") % 3 == 0, None).otherwise((F.col("turn") % 5) / 10).alias("comment_ratio"),
            F.when(F.col("turn") % 4 == 3, None).otherwise(F.col("turn") + 1).alias("cyclomatic_complexity"), (F.col("turn") % 4 != 2).alias("is_latest"),
            F.when(e % 3 != 0, F.sha1(e.cast("string"))).alias("git_commit_hash"), F.date_add(F.lit("2024-01-01").cast("date"), (e % 60).cast("int")).cast("timestamp_ntz").alias("indexed_at"), F.col("turn").alias("created_at"),
        )

    @property
    def hierarchy(self) -> DataFrame:
        """parent, child, ordinal: regions, nations and customers as one tree of names."""
        n, c = self.table("nation"), self.table("customer")
        return n.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"), F.col("n_nationkey").cast("bigint").alias("ordinal")).unionAll(
            c.select(F.concat(F.lit("n"), F.col("c_nationkey")), F.concat(F.lit("c"), F.col("c_custkey")), F.col("c_custkey"))
        )

    @property
    def chain(self) -> DataFrame:
        """parent, child, ordinal: each message under the one before it."""
        c = self.table("conversations").filter("turn > 0")
        return c.select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"), (F.col("conv_id") * 1000 + F.col("turn")).alias("child"), F.lit(0).cast("bigint").alias("ordinal"))

    @property
    def dependencies(self) -> DataFrame:
        line = self.table("lineitem")
        return line.select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("dep_type"), F.when(F.col("l_linenumber") != 1, F.col("l_linestatus")).alias("symbol"), F.col("l_shipdate").alias("created_at"))

    @property
    def snapshot_files(self) -> DataFrame:
        f, seen = self.files, self.table("labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("_seen"))
        path = F.when(F.col("id") % 11 == 0, F.concat_ws("/", "language", F.lit("docs/adr"), F.col("id").cast("string"))).when(F.col("id") % 13 == 0, F.concat_ws("/", "path", F.lit("readme.MD"))).otherwise(F.col("path"))
        return f.join(seen, "id", "left").select("id", F.split("path", "/")[0].alias("snapshot_id"), path.alias("file_path"), F.col("size").alias("file_size"), "domain", F.coalesce("_seen", F.lit(False)).alias("indexed"))

    @property
    def summaries(self) -> DataFrame:
        f, i = self.files, F.col("id")
        kind = F.when(i % 3 == 0, "file").when(i % 3 == 1, "directory").otherwise("architecture")
        arch = F.when(i % 3 == 2, F.element_at(F.array(*[F.lit(x) for x in ("overview", "tech_stack", "data_flow", "components")]), (i % 4 + 1).cast("int")))
        return f.select("id", "snapshot_id", kind.alias("summary_type"), F.when(i % 3 == 2, "").otherwise(F.col("path")).alias("target_path"), F.when(i % 3 == 1, (i % 6).cast("int")).alias("depth"), arch.alias("arch_type"), "content", F.col("content_hash"), "created_at")

    @property
    def commits(self) -> DataFrame:
        """path, hash, author, ts: one row a change of a file."""
        return self._commits(self.table("events"))

    @property
    def commit_stream(self) -> DataFrame:
        """The same as a stream of the table's files."""
        return self._commits(self.spark.readStream.schema(self.table("events").schema).parquet(f"{self.sf_dir}/events.parquet*"))

    @staticmethod
    def _commits(e: DataFrame) -> DataFrame:
        return e.select(F.concat(F.lit("u"), F.col("user_id"), F.lit(".go")).alias("path"), F.sha1(F.col("event_id").cast("string")).alias("hash"), F.col("event_type").alias("author"), "ts", "event_id")

    def query_vector(self, vec_id: int = 0) -> list[float]:
        return self.table("embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]
