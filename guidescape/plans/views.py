"""The operators' inputs as views over the benchmark tables.

Orders and customers play cells and their guides, lineitems the associations, embeddings the expression matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from guidescape.operators.clean import with_guide
from guidescape.operators.counts import cluster_guide_counts
from guidescape.operators.sparse import CellMatrix

CLUSTERS = [0, 1, 2, 3, 4]
CONTROL = "0"
# Names on the guide axis that no cell carries, so that completed profiles always have gaps to fill.
UNSEEN = ["Z0.0", "Z0.1"]
# Entries of the sparse matrix are those above this.
SPARSE_LIMIT = 0.05


def _cluster_of(priority: str):
    return F.substring(priority, 1, 1).cast("int") - 1


def _mean_discount():
    """Mean discount from whole percent steps: integer sums make thresholds cut the same everywhere."""
    percent = F.round(F.col("l_discount") * 100).cast("long")
    return F.sum(percent).cast("double") / F.count(F.lit(1)) / 100


class Views:
    """Lazily built inputs of one data folder; every property is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @property
    def cells(self) -> DataFrame:
        orders, customer = self.table("orders"), self.table("customer")
        label = F.when(F.col("c_nationkey") == 0, F.lit(CONTROL)).otherwise(
            F.concat(F.lit("N"), "c_nationkey", F.lit("."), F.col("c_custkey") % 4, F.lit(".sg"))
        )
        raw = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
            F.col("o_orderkey").alias("cell_id"),
            _cluster_of("o_orderpriority").alias("louvain"),
            label.alias("guide_cov"),
            F.col("c_mktsegment").alias("donor_cov"),
            F.col("o_totalprice").alias("numi_cov"),
        )
        return with_guide(raw, "guide_cov")

    @property
    def guide_genes(self) -> DataFrame:
        items, supplier, part = self.table("lineitem"), self.table("supplier"), self.table("part")
        rows = items.join(supplier, items["l_suppkey"] == supplier["s_suppkey"]).join(
            part, items["l_partkey"] == part["p_partkey"]
        )
        guide = F.concat(F.lit("N"), "s_nationkey", F.lit("."), F.col("l_partkey") % 4)
        return rows.groupBy(guide.alias("guide"), F.col("p_brand").alias("gene")).agg(
            _mean_discount().alias("fdr"), F.count(F.lit(1)).alias("support")
        )

    @property
    def sig(self) -> DataFrame:
        return self.guide_genes.where("fdr < 0.05")

    @property
    def sigpos(self) -> DataFrame:
        return self.guide_genes.where("fdr < 0.045")

    @property
    def cluster_genes(self) -> DataFrame:
        items, orders, part = self.table("lineitem"), self.table("orders"), self.table("part")
        rows = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).join(
            part, items["l_partkey"] == part["p_partkey"]
        )
        return rows.groupBy(_cluster_of("o_orderpriority").alias("cluster"), F.col("p_brand").alias("gene")).agg(
            _mean_discount().alias("fdr")
        )

    @property
    def cluster_sig(self) -> DataFrame:
        return self.cluster_genes.where("fdr < 0.05")

    @property
    def feature_lists(self) -> DataFrame:
        """Per cluster the eight guides with the highest and the lowest share of their cells in it."""
        counts = cluster_guide_counts(self.cells).where(F.col("guide") != CONTROL)
        totals = counts.groupBy("guide").agg(F.sum("n").alias("k"))
        share = counts.join(totals, "guide").withColumn("share", F.col("n").cast("double") / F.col("k"))
        own = Window.partitionBy("louvain")
        ranked = share.withColumn("high", F.row_number().over(own.orderBy(F.desc("share"), "guide"))).withColumn(
            "low", F.row_number().over(own.orderBy("share", "guide"))
        )

        def names(rank: str):
            return F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col(rank) <= 8, F.col("guide")))))

        return (
            ranked.where("high <= 8 or low <= 8")
            .groupBy(F.col("louvain").alias("cluster"))
            .agg(names("high").alias("enriched"), names("low").alias("depleted"))
        )

    def _with_unseen(self, guides: DataFrame) -> DataFrame:
        extra = self.spark.createDataFrame([(g,) for g in UNSEEN], "guide string")
        return guides.select("guide").distinct().unionByName(extra)

    @property
    def scaffold(self) -> DataFrame:
        control = self.spark.createDataFrame([(CONTROL,)], "guide string")
        return self._with_unseen(self.guide_genes.select("guide").unionByName(control))

    # --- expression side -------------------------------------------------------------------------------------------

    @property
    def matrix(self) -> DataFrame:
        """One row per cell with all its values: cell_id, louvain, guide, label, values."""
        r = F.col("vec_id") % 12
        guide = F.when(r == 0, F.lit(CONTROL)).otherwise(F.concat(F.lit("G"), r, F.lit(".1")))
        return self.table("embeddings").select(
            F.col("vec_id").alias("cell_id"),
            (F.col("label") % 5).alias("louvain"),
            guide.alias("guide"),
            "label",
            F.transform("embedding", lambda v: v.cast("double")).alias("values"),
        )

    @property
    def genes(self) -> DataFrame:
        """Gene dictionary: pos, gene."""
        widest = self.table("embeddings").agg(F.max(F.size("embedding")).alias("n"))
        return widest.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos")).select(
            "pos", F.concat(F.lit("g"), "pos").alias("gene")
        )

    @property
    def expr(self) -> DataFrame:
        return self.matrix.select("cell_id", "louvain", "guide", F.posexplode("values").alias("pos", "value")).select(
            "cell_id", "louvain", "guide", F.concat(F.lit("g"), "pos").alias("gene"), "value"
        )

    @property
    def sparse(self) -> CellMatrix:
        """The matrix with only its entries above ``SPARSE_LIMIT``."""
        kept = F.transform("values", lambda v: F.when(v > SPARSE_LIMIT, v).otherwise(0.0))
        return CellMatrix.from_dense(self.matrix.withColumn("values", kept), self.genes)

    @property
    def expr_pos(self) -> DataFrame:
        return self.expr.withColumn("value", F.col("value") + 1)

    @property
    def expr_scaffold(self) -> DataFrame:
        return self._with_unseen(self.matrix)

    @property
    def timed(self) -> DataFrame:
        """Cells with a given pseudotime and branch."""
        return self.matrix.select(
            "cell_id",
            "louvain",
            "guide",
            ((F.col("cell_id") % 100) / 99.0).alias("pseudotime"),
            (F.col("cell_id") % 2).alias("branch"),
        )

    @property
    def gene_lists(self) -> DataFrame:
        """Two search lists, picked from the gene dictionary."""
        genes = self.genes
        lists = F.when(F.col("gene").isin("g0", "g1", "g2"), 0).when(F.col("gene").isin("g10", "g11"), 1)
        return genes.select(lists.alias("list_id"), "gene").where("list_id is not null")
