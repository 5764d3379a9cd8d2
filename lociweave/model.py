"""The data model: a sample-by-mutation matrix held as a shared directed acyclic graph, in tables.

A sample carries a mutation if a downward path leads from the mutation's node to the sample. Values
are summed over paths: in a graph with diamonds results count paths.

=============== ==================================================================
nodes           node_id long, is_sample boolean, num_coals long (null: not set)
edges           parent long, child long (duplicates allowed)
mutations       mut_id long, position long, ref string, alt string, time int
mutation_node   mut_id long, node_id long (null: no carriers), miss_node_id long
samples         sample_idx long, node_id long, individual_idx long, pop_id int
individuals     individual_idx long, individual_id string
populations     pop_id int, description string
=============== ==================================================================
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alternative allele that stands for missing data in input rows.
MISSING = "."
__version__ = "0.1"
FORMAT_VERSION = (1, 0)

SCHEMAS = {
    "nodes": "node_id long, is_sample boolean, num_coals long",
    "edges": "parent long, child long",
    "mutations": "mut_id long, position long, ref string, alt string, time int",
    "mutation_node": "mut_id long, node_id long, miss_node_id long",
    "samples": "sample_idx long, node_id long, individual_idx long, pop_id int",
    "individuals": "individual_idx long, individual_id string",
    "populations": "pop_id int, description string",
}


@dataclass(frozen=True)
class VariantGraph:
    """A graph and what hangs on it. Immutable: operations return a new one."""

    nodes: DataFrame
    edges: DataFrame
    mutations: DataFrame
    mutation_node: DataFrame
    samples: DataFrame
    individuals: DataFrame
    populations: DataFrame
    ploidy: int = 2
    phased: bool = True
    specified_range: tuple[int, int] | None = None
    extra: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def having(self, **tables) -> VariantGraph:
        return replace(self, **tables)

    # counts and shapes

    def num_samples(self) -> int:
        return self.samples.count()

    def num_individuals(self) -> int:
        return self.num_samples() // self.ploidy

    def num_mutations(self) -> int:
        return self.mutations.count()

    def num_nodes(self) -> int:
        return self.nodes.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def shape(self) -> tuple[int, int]:
        return self.num_individuals(), self.num_mutations()

    def haploid_shape(self) -> tuple[int, int]:
        return self.num_samples(), self.num_mutations()

    def bp_range(self) -> tuple[int, int] | None:
        """First position and one past the last."""
        r = self.mutations.agg(F.min("position"), F.max("position") + 1).first()
        return None if r[0] is None else (r[0], r[1])

    # order

    def nodes_are_ordered(self) -> bool:
        """Every parent has a larger id than its children."""
        return not self.edges.where("parent <= child").take(1)

    def samples_are_ordered(self) -> bool:
        return not self.samples.where("sample_idx <> node_id").take(1)

    def mutations_are_ordered(self) -> bool:
        """Ids follow (position, ref, alt)."""
        a, b = self.mutations.alias("a"), self.mutations.alias("b")
        later = F.struct("b.position", "b.ref", "b.alt") < F.struct("a.position", "a.ref", "a.alt")
        return not a.join(b, F.col("b.mut_id") == F.col("a.mut_id") + 1).where(later).take(1)

    def has_missing_data(self) -> bool:
        return bool(self.mutation_node.where("miss_node_id is not null").take(1))

    def has_individual_ids(self) -> bool:
        return bool(self.individuals.take(1))

    def has_individual_coals(self) -> bool:
        return not self.nodes.where("not is_sample and num_coals is null").take(1)

    # lookups

    def down_degrees(self) -> DataFrame:
        return self.nodes.join(self.edges.groupBy(F.col("parent").alias("node_id")).agg(F.count("*").alias("n")), "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n_down"))

    def up_degrees(self) -> DataFrame:
        return self.nodes.join(self.edges.groupBy(F.col("child").alias("node_id")).agg(F.count("*").alias("n")), "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n_up"))

    def down_edges(self, node: int) -> list[int]:
        return sorted(r.child for r in self.edges.where(F.col("parent") == node).collect())

    def up_edges(self, node: int) -> list[int]:
        return sorted(r.parent for r in self.edges.where(F.col("child") == node).collect())

    def sample_nodes(self) -> DataFrame:
        return self.samples.orderBy("sample_idx").select("node_id")

    def root_nodes(self) -> DataFrame:
        """Nodes without a parent."""
        return self.nodes.join(self.edges.select(F.col("child").alias("node_id")), "node_id", "left_anti").select("node_id")

    def node_mutation_pairs(self) -> DataFrame:
        """(node, mutation), unmapped ones first."""
        return self.mutation_node.orderBy(F.asc_nulls_first("node_id"), "mut_id").select("node_id", "mut_id", "miss_node_id")

    def mutation_node_pairs(self) -> DataFrame:
        return self.mutation_node.orderBy("mut_id").select("mut_id", "node_id", "miss_node_id")

    def mutations_for_node(self, node: int) -> DataFrame:
        return self.mutation_node.where(F.col("node_id") == node).select("mut_id", "miss_node_id")

    def unmapped_mutations(self) -> DataFrame:
        return self.mutation_node.where("node_id is null").select("mut_id")

    def nodes_with_mutations(self) -> DataFrame:
        return self.nodes.join(self.mutation_node.where("node_id is not null").select("node_id"), "node_id", "left_semi").select("node_id")

    def mutation_by_id(self, mut_id: int) -> DataFrame:
        return self.mutations.where(F.col("mut_id") == mut_id)

    def __repr__(self) -> str:
        return f"VariantGraph(ploidy={self.ploidy}, phased={self.phased}, tables={list(SCHEMAS)})"


def from_rows(spark: SparkSession, n_samples: int, edges, mutations=(), ploidy: int = 2, populations=(), sample_pops=None, individual_ids=(), n_nodes: int | None = None) -> VariantGraph:
    """A graph from small Python lists: edges (parent, child); mutations (position, ref, alt, node, miss_node)."""
    if n_samples <= 0 or n_samples % ploidy:
        raise ValueError("the number of samples must be a positive multiple of the ploidy")
    top = n_nodes if n_nodes is not None else max([n_samples - 1, *(max(e) for e in edges)]) + 1
    made = lambda rows, name: spark.createDataFrame(rows, SCHEMAS[name])
    return VariantGraph(
        made([(i, i < n_samples, None) for i in range(top)], "nodes"),
        made(list(edges), "edges"),
        made([(k, m[0], m[1], m[2], None) for k, m in enumerate(mutations)], "mutations"),
        made([(k, m[3], m[4] if len(m) > 4 else None) for k, m in enumerate(mutations)], "mutation_node"),
        made([(i, i, i // ploidy, sample_pops[i] if sample_pops else None) for i in range(n_samples)], "samples"),
        made(list(enumerate(individual_ids)), "individuals"),
        made(list(enumerate(populations)), "populations"),
        ploidy,
    )


def empty_graph(spark: SparkSession, n_samples: int, ploidy: int = 2, phased: bool = True) -> VariantGraph:
    """Sample nodes only."""
    return from_rows(spark, n_samples, [], ploidy=ploidy).having(phased=phased)
