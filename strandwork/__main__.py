"""The assembler as a command: reads of a FASTA file in, contigs and figures out.

python -m strandwork -f reads.fa -c 100 -o out [-k 32] [-t 21] [-n 100000] ...
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import AssemblyConfig
from .plans.assembly import assemble
from .sources import reads


def options(argv: list[str] | None = None) -> argparse.Namespace:
    defaults = AssemblyConfig()
    p = argparse.ArgumentParser(prog="strandwork", description="De-novo assembly of short reads.")
    p.add_argument("-f", "--fasta", required=True, help="reads: a file, a folder or a pattern")
    p.add_argument("-c", "--coverage", type=int, required=True, help="expected coverage")
    p.add_argument("-o", "--out", required=True, help="folder for contigs/, figures/ and rounds/")
    p.add_argument("-k", type=int, default=defaults.k, help="length of k-mers, up to 64 (%(default)s)")
    p.add_argument("-l", type=int, default=defaults.l, help="length of minimizers (%(default)s)")
    p.add_argument("-t", "--buckets", type=int, default=defaults.num_buckets, help="buckets of the abundance histogram (%(default)s; 0 for that)")
    p.add_argument("-n", "--nodes", type=int, default=defaults.node_threshold, help="compaction ends at so many nodes (%(default)s; 0 for that)")
    p.add_argument("--cutoff", type=int, help="least count of a k-mer; else from the histogram")
    p.add_argument("--min-contig", type=int, default=defaults.min_contig_len, help="contigs have more bases than this (%(default)s)")
    p.add_argument("--on-invalid", choices=["split", "error", "as_A"], default=defaults.on_invalid)
    p.add_argument("--walk", choices=["reference", "full"], default=defaults.walk_mode)
    p.add_argument("--checkpoint", help="folder that all executors share, if spark.checkpoint.dir is unset")
    return p.parse_args(argv)


def run(spark: SparkSession, o: argparse.Namespace) -> None:
    defaults = AssemblyConfig()
    if o.checkpoint and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", o.checkpoint)
    config = AssemblyConfig(
        k=o.k, l=o.l, coverage=o.coverage, num_buckets=o.buckets or defaults.num_buckets, cutoff=o.cutoff, node_threshold=o.nodes or defaults.node_threshold,
        min_contig_len=o.min_contig, on_invalid=o.on_invalid, walk_mode=o.walk,
    )
    done = assemble(reads.fasta(spark, o.fasta), config)
    reads.write_contigs(done.contigs, f"{o.out}/contigs", config.min_contig_len)
    done.stats().coalesce(1).write.json(f"{o.out}/figures")
    done.round_figures().coalesce(1).write.json(f"{o.out}/rounds")


if __name__ == "__main__":
    run(SparkSession.builder.appName("strandwork").getOrCreate(), options())
