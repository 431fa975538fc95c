"""The tables of the network pipeline over one set of input tables, built lazily from each other."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import corpus, graphs, institutions, layers, nested, network, quality
from weftline.plans.tables import table
from weftline.session import Scratch


_BUNDLES: dict[tuple, "Bundle"] = {}


def input_identity(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of change of every input file, so that rewritten input is never answered from old tables."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def forget() -> None:
    """Let later queries build their tables anew."""
    _BUNDLES.clear()


class Bundle:
    """Each property is a lazy DataFrame; nothing is computed before a query asks for it.

    Tables that a query reads several times are written once to the shared folder (``shared``), so
    that their upstream joins run once and no lineage grows behind them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.scratch = Scratch(spark, "bundle")

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Bundle":
        """The bundle of this application and these input files; its written tables serve all queries of a run."""
        key = (spark.sparkContext.applicationId, sf_dir, input_identity(spark, sf_dir))
        old = _BUNDLES.get(key)
        if old is None or not old.scratch.intact():
            old = _BUNDLES[key] = cls(spark, sf_dir)
        return old

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def shared(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.write(df, name)

    @cached_property
    def works(self) -> DataFrame:
        return corpus.normalized_works(self.raw("works"))

    @cached_property
    def tagged(self) -> DataFrame:
        """All nested elements of the delivered works, read and written once, a folder for each tag."""
        path = f"{self.scratch.root}/tagged"
        rows = nested.flat_rows(self.raw("works"), nests=nested.FLAT_NESTS, payload=True)
        nested.write_tagged(rows, path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @cached_property
    def topics(self) -> DataFrame:
        return self.shared(corpus.work_topics(self.works, self.raw("topic_registry")), "topics")

    @cached_property
    def references(self) -> DataFrame:
        return corpus.work_references(self.works)

    @cached_property
    def versions(self) -> DataFrame:
        return corpus.version_families(self.works)

    @cached_property
    def corpus(self) -> DataFrame:
        return self.shared(corpus.corpus_flags(self.works, self.topics, self.versions), "corpus")

    @cached_property
    def extracted(self) -> DataFrame:
        return self.shared(institutions.extracted(self.works), "extracted")

    @cached_property
    def inst(self) -> DataFrame:
        return self.shared(institutions.with_geography(institutions.institution_rows(self.raw("institutions"))), "inst")

    @cached_property
    def views(self) -> DataFrame:
        return self.shared(institutions.hierarchy_views(self.inst), "views")

    @cached_property
    def wi(self) -> DataFrame:
        return self.shared(institutions.work_institutions(self.extracted, self.corpus, self.inst, self.views), "wi")

    @cached_property
    def groups(self) -> DataFrame:
        return self.shared(network.work_groups(self.wi), "groups")

    @cached_property
    def pairs(self) -> DataFrame:
        return network.pairs(self.groups)

    @cached_property
    def edges(self) -> DataFrame:
        return self.shared(network.edges_year(self.pairs, self.inst), "edges")

    @cached_property
    def outputs(self) -> DataFrame:
        return self.shared(network.outputs(self.groups, self.inst), "outputs")

    @cached_property
    def flows(self) -> DataFrame:
        return self.shared(network.flows(self.pairs), "flows")

    @cached_property
    def intensity(self) -> DataFrame:
        return self.shared(network.intensity(self.edges, self.outputs), "intensity")

    @cached_property
    def graph(self) -> DataFrame:
        return graphs.graph_rows(self.edges, self.outputs)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.shared(network.node_metrics(self.edges, self.outputs), "nodes")

    @cached_property
    def pagerank(self) -> DataFrame:
        return self.shared(graphs.by_size(self.edges, self.outputs, graphs.pagerank, graphs.pagerank_distributed), "pagerank")

    @cached_property
    def components(self) -> DataFrame:
        return self.shared(graphs.by_size(self.edges, self.outputs, graphs.components, graphs.components_distributed), "components")

    @cached_property
    def ranked_nodes(self) -> DataFrame:
        return self.shared(self.nodes.join(self.pagerank, [*network.VIEW, "institution_id"]), "ranked")

    @cached_property
    def communities(self) -> DataFrame:
        return self.shared(graphs.communities(self.graph), "communities")

    @cached_property
    def layout(self) -> DataFrame:
        return self.shared(graphs.layout(self.edges, self.nodes), "layout")

    @cached_property
    def citations(self) -> DataFrame:
        return self.shared(layers.citation_flows(self.groups, self.references), "citations")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.shared(layers.topic_vectors(self.groups, self.topics), "vectors")

    @cached_property
    def similarity(self) -> DataFrame:
        return self.shared(layers.topic_similarity(self.vectors, digits=9), "similarity")

    @cached_property
    def scope(self) -> DataFrame:
        return quality.scope_sensitivity(self.wi)
