"""Command line: `convert` a graph to Parquet, `match` a pattern, `degree` of a vertex."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from graphloom.sources.config import Config


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in ("convert", "match", "degree"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    config = Config.load(spark, None, argv[1:])
    from graphloom.model import Graph, Pattern
    from graphloom.operators.analytics import degree_of
    from graphloom.operators.simulate import simulate
    from graphloom.sinks import write_matches
    from graphloom.sources.readers import read_attributes, read_graph, write_shards

    edges = read_graph(spark, config.string("file"), config.string("filetype"), config.values.get("edgedatatype"))
    if argv[0] == "convert":
        write_shards(edges, config.string("outputfile"), config.integer("nshards", 0) or None)
    elif argv[0] == "degree":
        degree_of(edges, config.integer("vertex")).show()
    else:
        graph = Graph(read_attributes(spark, config.string("vertexfile")), edges, attrs="attrs")
        matches = simulate(graph, Pattern.load(spark, config.string("queryfile")), include_isolated=config.flag("include_isolated"))
        write_matches(matches, config.string("outputfile"))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
