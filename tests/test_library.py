import glob
import os
import random
import sys
import tracemalloc
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwork import __main__ as command
from strandwork import tables
from strandwork.config import AssemblyConfig
from strandwork.functions import encoding as E
from strandwork.functions import small, superkmers
from strandwork.operators import compaction, graph, kmers, sorting, walk, wiring
from strandwork.plans import assembly, oracle, queries
from strandwork.sources import logs
from strandwork.sources import reads as R
from strandwork.streaming import counting
from strandwork.streaming.counting import count_stream

from simulator import Graph, kmer_counts

sys.setrecursionlimit(20_000)
SF = "/root/testdata/sf0.001"
#: The worked example: three sequences with their multiplicities.
EXAMPLE = ["ACCTGA"] * 3 + ["ACCTTA"] * 2 + ["GACCTG"]


def frame(spark, seqs):
    return spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(seqs)], "read_id long, header string, seq string")


def digits(s):
    return s.translate(str.maketrans("ACTG", "0123"))


def random_reads(seed, n=40, length=14):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(60))
    out = []
    for _ in range(n):
        at = rng.randrange(len(genome) - length)
        s = list(genome[at : at + length])
        if rng.random() < 0.3:
            s[rng.randrange(length)] = rng.choice("ACGT")
        out.append("".join(s))
    return out


def test_encoding(spark):
    row = spark.range(1).select(
        E.encode(F.lit("ACTGacgt")).alias("d"), E.decode(F.lit("0123")).alias("b"), E.base_code(F.lit("N")).alias("n"), E.base_code(F.lit("g")).alias("g"),
        E.lenient(F.lit("acNxT")).alias("lenient"), E.number(F.lit("3210")).alias("v"), E.letters_to_bases(F.lit("aB-é z")).alias("letters"),
        E.prefix(F.lit("0123"), 4).alias("p"), E.suffix(F.lit("0123"), 4).alias("s"), E.shifted(F.lit("0123"), F.lit("2"), 4).alias("sh"), E.base_at(F.lit("0123"), 2).alias("at"),
        E.top_bit(F.lit(256)).alias("top"), E.byte_digit(F.lit(0x010203).cast("long"), 1, 2).alias("byte"), E.range_partition(F.lit(255), 4, 4).alias("range"),
    ).first()
    assert tuple(row) == ("01230132", "ACTG", 7, 3, "ACAAT", 228, "ACC", "012", "123", "1232", "2", 8, 2, 3)
    with pytest.raises(Exception, match="not a base sequence"):
        spark.range(1).select(E.strict(F.lit("ACN"))).collect()


def test_hash31(spark):
    def plain(x):
        r = (68111 * x + 105929) % (1 << 64)
        r = r - (1 << 64) if r >= 1 << 63 else r
        return ((r >> 31) + r) & ((1 << 31) - 1)

    xs = [0, 1, 65535, 4**31 - 1, (1 << 62) + 12345, (1 << 63) - 1]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", E.hash31(F.col("x")).alias("h")).collect()
    assert {r.x: r.h for r in got} == {x: plain(x) for x in xs}


@pytest.mark.parametrize("k", [1, 4, 32, 64])
def test_counts(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, k - 1, k, k, 90, 90)] + ["A" * 80]
    got = {r.kmer: r.cnt for r in kmers.counts(frame(spark, seqs), k).collect()}
    assert got == dict(kmer_counts([digits(s) for s in seqs], k))
    total = kmers.totals(kmers.counts(frame(spark, seqs), k)).first()
    assert total.n_total == sum(max(0, len(s) - k + 1) for s in seqs)


def test_invalid_characters(spark):
    reads = frame(spark, ["ACGNACGT", "acg"])
    count = lambda how: sorted(kmers.counts(reads, 3, how).select(E.decode("kmer")).toPandas().iloc[:, 0])
    assert count("split") == ["ACG", "CGT"]
    assert {E_decode(r.kmer): r.cnt for r in kmers.counts(reads, 2).collect()} == {"AC": 3, "CG": 3, "GT": 1}
    assert {E_decode(r.kmer): r.cnt for r in kmers.counts(reads, 4).collect()} == {"ACGT": 1}
    assert "CGA" in count("as_A")
    with pytest.raises(Exception, match="not a base sequence"):
        count("error")


def test_histogram_and_cutoff(spark):
    c = spark.createDataFrame([(f"k{i}", n) for i, n in enumerate([1, 1, 1, 2, 2, 4, 4, 9])], "kmer string, cnt long")
    h = kmers.histogram(c, 6)
    assert {r.bucket: r.n for r in h.collect()} == {1: 3, 2: 2, 3: 0, 4: 2, 5: 0}
    assert kmers.cutoff(h).first().cutoff == 3  # the first of two empty buckets
    with pytest.raises(ValueError, match="no k-mer"):
        assembly.assemble(frame(spark, ["ACGTACGT"]), AssemblyConfig(k=4, l=2, cutoff=9))


def test_minimizers(spark):
    seqs = random_reads(5)
    lmers = kmer_counts([digits(s) for s in seqs], 3)
    reads = frame(spark, seqs)
    freq = kmers.counts(reads, 3, name="lmer").withColumnRenamed("cnt", "freq")
    got = {r.kmer: r.minimizer for r in kmers.minimizers(kmers.counts(reads, 8), freq, 8, 3).collect()}
    for kmer, m in got.items():
        assert m == min((lmers[kmer[i : i + 3]], i, kmer[i : i + 3]) for i in range(6))[2]


def wires_of(spark, seqs, k, coverage=1, least=1):
    ext = graph.build(kmers.solid(kmers.counts(frame(spark, seqs), k), least), k, coverage)
    return ext, wiring.wires(ext)


def test_wiring_of_the_example(spark):
    ext, wired = wires_of(spark, EXAMPLE, 4)
    text = {(r.node, r.side, r.ext_id): r.ext for r in ext.collect()}
    got = {(E_decode(r.node), E_decode(text[r.node, "P", r.p_id]), E_decode(text[r.node, "S", r.s_id]), r.off_p, r.off_s, r.cnt) for r in wired.collect()}
    assert got == {
        ("ACC", "", "T", 0, 0, 5), ("ACC", "G", "T", 0, 5, 1), ("CCT", "A", "G", 0, 0, 4), ("CCT", "A", "T", 4, 0, 2), ("CTT", "C", "A", 0, 0, 2),
        ("CTG", "C", "A", 0, 0, 3), ("CTG", "C", "", 3, 0, 1), ("TTA", "C", "", 0, 0, 2), ("TGA", "C", "", 0, 0, 3), ("GAC", "", "C", 0, 0, 1),
    }
    row = wiring.invariants(ext, wired).first()
    assert (row.n_unbalanced, row.n_visits) == (0, row.n_wired)


def E_decode(s):
    return s.translate(str.maketrans("0123", "ACTG"))


@pytest.mark.parametrize(
    ("mode", "threshold", "want"),
    [
        ("reference", 10**6, ["ACCTGA", "GACCTTA"]),
        ("full", 10**6, ["ACCTG", "ACCTGA", "ACCTTA", "GACCTTA"]),
        ("reference", 2, ["ACCTGA", "GACCTG"]),
        ("full", 2, ["ACCTGA", "ACCTTA", "GACCTG"]),
    ],
)
def test_walks_of_the_example(spark, mode, threshold, want):
    done = assembly.assemble(frame(spark, EXAMPLE), AssemblyConfig(k=4, l=2, coverage=1, cutoff=1, node_threshold=threshold, walk_mode=mode))
    assert sorted(E_decode(r.contig) for r in done.contigs.where("source = 'walk'").collect()) == want
    assert done.rounds == ([] if threshold > 100 else [(7, 3, 3), (4, 2, 3)])


@pytest.mark.parametrize("seed", range(3))
def test_graph_against_simulator(spark, seed):
    seqs, k = random_reads(seed), 6
    sim = Graph({m: c for m, c in kmer_counts([digits(s) for s in seqs], k).items() if c >= 2}, k, 2)
    walked = sorted(sim.walks())
    rounds, partial = [], []
    while len(sim.nodes) > 6:
        *r, contigs = sim.round()
        rounds.append(tuple(r))
        partial += contigs
    config = AssemblyConfig(k=k, l=2, coverage=2, cutoff=2, node_threshold=6)
    done = assembly.assemble(frame(spark, seqs), config)
    assert done.rounds == rounds
    assert sorted(r.contig for r in done.contigs.where("source = 'partial'").collect()) == sorted(partial)
    assert sorted(r.contig for r in done.contigs.where("source = 'walk'").collect()) == sorted(sim.walks())
    assert sorted(r.contig for r in walk.walk(done.graph, k).collect()) == walked


def test_self_loop(spark):
    ext, wired = wires_of(spark, ["AAAAAAAA", "AAAAAC"], 4)
    assert wiring.invariants(ext, wired).first().n_unbalanced == 0
    done = assembly.assemble(frame(spark, ["AAAAAAAA", "AAAAAC"]), AssemblyConfig(k=4, l=2, coverage=100, cutoff=1, node_threshold=1))
    assert done.rounds


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x->y\nACGT\n>two\r\nAC\r\nGT\r\n>three\nTTTT\n")
    got = R.fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r.header, r.seq) for r in got.collect()) == [("one x->y", "ACGT"), ("three", "TTTT"), ("two", "ACGT")]
    assert got.select("read_id").distinct().count() == 3
    (tmp_path / "b.txt").write_text("x||yy||||z")
    assert sorted(r.record for r in R.records(spark, str(tmp_path / "b.txt"), "||").collect()) == ["x", "yy", "z"]


def test_logs(spark, tmp_path):
    (tmp_path / "a.out").write_text(
        "K-mer size: 32, L-mer size: 8, Number of Processes: 4, Coverage: 100\nTotal number of reads: 1000\n"
        "Average time for performing k-mer counting across all procs (secs): 66.5 \nTotal distinct k-mer entries across all proc's: 77\n"
        "Itr: 1, Total number of macro_nodes across all proc's: 90 [min=1]\nItr: 2, Total number of macro_nodes across all proc's: 60 [min=1]\n[elapsed-time-no-io]: 8.25\n"
    )
    row = logs.runs(spark, str(tmp_path)).first()
    assert row.asDict() == {"file": "a.out", "n_reads": 1000, "n_processes": 4, "n_distinct": 77, "counting_s": 66.5, "elapsed_s": 8.25, "first_nodes": 90, "last_nodes": 60, "n_rounds": 2}


def test_contig_file(spark, tmp_path):
    c = spark.createDataFrame([("0123" * 3, 12, "walk"), ("0" * 5, 5, "walk")], "contig string, len int, source string")
    R.write_contigs(c, str(tmp_path / "out"), min_len=5)
    lines = [x for f in glob.glob(str(tmp_path / "out/part*")) for x in open(f).read().splitlines()]
    assert len(lines) == 2 and lines[0].startswith(">contig_") and lines[1] == "ACTG" * 3


def test_shred(spark):
    got = R.shred(frame(spark, ["ACGTACGTAC", "ACG"]), 4, 3).collect()
    assert [r.seq for r in sorted(got, key=lambda r: r.read_id)] == ["ACGT", "TACG", "GTAC"]


def test_sorting(spark):
    df = spark.createDataFrame([(x,) for x in [513, 3, 3, 70000, 255]], "v long")
    assert [r.v for r in sorting.sort_integers(df, "v", True).collect()] == [3, 255, 513, 70000]
    assert tuple(sorting.most_significant_bit(df, "v").first()) == (2, 0)
    dealt = sorting.shuffle_by_byte(df, "v", 0, 4).withColumn("p", F.spark_partition_id()).collect()
    assert {r.v: r.processor for r in dealt} == {v: min(v % 256 // 64, 3) for v in (513, 3, 70000, 255)}
    assert len({r.p for r in dealt}) == len({r.processor for r in dealt})


def test_stream_of_several_batches(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(["acgtacgt", "ttttttt", "acgtt"])]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    got = {r.kmer: r.cnt for r in count_stream(spark, str(tmp_path / "in/*"), 3).collect()}
    bases = ["".join(E.LETTER_BASES[ord(c) - 97] for c in r[1]) for r in rows]
    assert got == dict(kmer_counts([digits(b) for b in bases], 3))


def test_folded_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counting, "FOLD", 2)
    test_stream_of_several_batches(spark, tmp_path)


def test_super_kmers():
    """Every k-mer stands in one super-k-mer, dealt by its minimizer; reads of any length, cut in pieces or not."""
    rng = random.Random(2)
    for k, m in ((20, 12), (21, 5), (32, 12)):
        seqs = ["".join(rng.choice("0123") for _ in range(n)) for n in (0, k - 1, k, 300, 900)] + ["0" * 70, "01230123N" + "0123" * 20]
        made = Counter()
        for batch in superkmers.super_kmers(k, m)(iter([pa.record_batch([pa.array([*seqs, None])], names=["_seq"])])):
            for bucket, seq, n in zip(*(batch[c].to_pylist() for c in ("bucket", "seq", "n"))):
                for i in range(len(seq) - k + 1):
                    made[bucket, seq[i : i + k]] += n
        want = Counter(w for s in seqs for i in range(len(s) - k + 1) if "N" not in (w := s[i : i + k]))
        assert len({w for _, w in made}) == len(made) and {w: n for (_, w), n in made.items()} == want


def test_super_kmers_of_long_reads(monkeypatch):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("0123") for _ in range(n)) for n in (5000, 30, 700, 20)]
    cut = lambda: Counter(seq[i : i + 20] for b in superkmers.super_kmers(20, 12)(iter([pa.record_batch([pa.array(seqs)], names=["s"])])) for seq, n in zip(b["seq"].to_pylist(), b["n"].to_pylist()) for i in range(len(seq) - 19) for _ in range(n))
    whole = cut()
    monkeypatch.setattr(superkmers, "CHUNK", 64)
    assert cut() == whole


def test_hub_is_wired_in_one_pass(spark):
    """A node with many extensions on both sides."""
    rng = random.Random(4)
    rows = [("n", side, f"{side}{i}", False, 1, v, i) for side in "PS" for i, v in enumerate([3, 7] * 200 if side == "P" else [rng.randrange(1, 5) for _ in range(400)] + [3000])]
    ext = spark.createDataFrame(rows, "node string, side string, ext string, terminal boolean, cnt long, visit long, ext_id int")
    order = lambda side: sorted((r for r in rows if r[1] == side), key=lambda r: (-r[5], len(r[2]), r[2]))
    spans = lambda side: [(r[6], sum(x[5] for x in order(side)[:i]), sum(x[5] for x in order(side)[: i + 1])) for i, r in enumerate(order(side))]
    want = {(p, s, max(a, c) - a, max(a, c) - c, min(b, d) - max(a, c)) for p, a, b in spans("P") for s, c, d in spans("S") if max(a, c) < min(b, d)}
    got = wiring.wires(ext)
    assert {(r.p_id, r.s_id, r.off_p, r.off_s, r.cnt) for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [0, 1 << 30], ids=["dealt", "everywhere"])
def test_walks_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(walk, "BROADCAST", limit)
    seqs, k = random_reads(1), 6
    sim = Graph({m: c for m, c in kmer_counts([digits(s) for s in seqs], k).items() if c >= 2}, k, 2)
    ext = graph.build(kmers.solid(kmers.counts(frame(spark, seqs), k), 2), k, 2)
    assert sorted(r.contig for r in walk.walk(ext, k, "full", keep_every=3).collect()) == sorted(sim.walks("full"))


def test_length_limit(spark, monkeypatch):
    monkeypatch.setattr(walk, "MOST", 5)
    ext = graph.build(kmers.counts(frame(spark, EXAMPLE), 4), 4, 1)
    with pytest.raises(Exception, match="a contig grew too long"):
        walk.walk(ext, 4).collect()


def test_compaction_leaves_no_state_behind(spark):
    folder = spark.conf.get("spark.checkpoint.dir") + "/strandwork"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    ext = graph.build(kmers.counts(frame(spark, random_reads(2)), 6), 6, 2)
    _, _, rounds = compaction.compact(ext, 6, 4)
    assert len(rounds) > 2 and len(set(os.listdir(folder)) - before) == 2  # the graph and the partial contigs


def test_command(spark, tmp_path):
    (tmp_path / "reads.fa").write_text("".join(f">r{i}\n{s}\n" for i, s in enumerate(EXAMPLE)))
    o = command.options(["-f", str(tmp_path / "reads.fa"), "-c", "1", "-o", str(tmp_path / "out"), "-k", "4", "-l", "2", "--cutoff", "1", "-n", "2", "--min-contig", "5"])
    command.run(spark, o)
    assert sorted(r.seq for r in R.fasta(spark, str(tmp_path / "out/contigs")).collect()) == ["ACCTGA", "GACCTG"]
    assert spark.read.json(str(tmp_path / "out/figures")).first().n_walk == 2
    assert [(r.n_nodes, r.n_chosen, r.n_messages) for r in spark.read.json(str(tmp_path / "out/rounds")).orderBy("round").collect()] == [(7, 3, 3), (4, 2, 3)]


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session)


def test_empty_input(spark):
    none = frame(spark, [])
    assert kmers.counts(none, 4).count() == 0
    assert R.read_stats(none, 4).first().n_reads == 0
    assert kmers.histogram(kmers.counts(none, 4), 4).count() == 3


def test_entry_and_twins():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", ["read_stats", "kmer_totals", "abundance_cutoff", "node_extensions", "wires", "transfers_round1", "compact_round1", "walk_contigs", "minimizer_load", "assembly_compacted", "round_figures", "node_dump", "fasta_reads", "delimited_records", "contig_records", "log_figures", "log_runs", "lmer_functions", "lenient_bases"])
def test_twin(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(oracle.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall())


def graph_and_simulator(spark, seed, n=40, length=14):
    seqs, k = random_reads(seed, n, length), 6
    sim = Graph({m: c for m, c in kmer_counts([digits(s) for s in seqs], k).items() if c >= 2}, k, 2)
    return graph.build(kmers.solid(kmers.counts(frame(spark, seqs), k), 2), k, 2), sim, k


@pytest.mark.parametrize("few, broadcast, mode", [(0, 0, "reference"), (0, 1 << 30, "full"), (1 << 30, 0, "reference"), (1 << 30, 0, "full")])
def test_walks_joined_and_at_once(spark, monkeypatch, few, broadcast, mode):
    monkeypatch.setattr(walk, "FEW", few)
    monkeypatch.setattr(walk, "BROADCAST", broadcast)
    ext, sim, k = graph_and_simulator(spark, 5)
    assert sorted(r.contig for r in walk.walk(ext, k, mode).collect()) == sorted(sim.walks(mode))


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_long_walks_take_few_jobs(spark, monkeypatch, few):
    """A step for each base would be 150 jobs of eight steps."""
    monkeypatch.setattr(walk, "FEW", few)
    rng = random.Random(3)
    text = "".join(rng.choice("ACTG") for _ in range(1200))
    ext = tables.cut(graph.build(kmers.counts(frame(spark, [text]), 31), 31, 1))
    tracker, group = spark.sparkContext.statusTracker(), f"long walk {few}"
    spark.sparkContext.setJobGroup(group, "")
    got = [r.contig for r in walk.walk(ext, 31).collect()]
    spark.sparkContext.setJobGroup("", "")
    assert got == [digits(text)]
    assert len(tracker.getJobIdsForGroup(group)) < 100


def test_edges_of_a_circle_stay(spark):
    """Four edges that follow each other in a circle, none of which is first, and three in a row."""
    ring = [(f"n{i}", 0, 0, 2, 0, str(i), False, f"n{(i + 1) % 4}", 0) for i in range(4)]
    row = [("a", 0, 0, 2, 1, "1", False, "b", 0), ("b", 0, 1, 2, 3, "2", False, "c", 0), ("c", 0, 3, 3, 0, "3", True, None, None)]
    schema = "node string, p_id int, start long, size long, off_s long, s_ext string, done boolean, next_node string, next_p int"
    begins = spark.createDataFrame([("a", "", 0, 2)], "node string, ext string, ext_id int, visit long")
    got = sorted(tuple(r) for r in walk.chained(tables.cut(spark.createDataFrame(ring + row, schema)), begins).collect())
    assert got == sorted([*ring, ("a", 0, 0, 2, 0, "123", True, None, None)])


@pytest.mark.parametrize("few, max_rounds", [(0, 3), (60, None), (1 << 30, 3), (1 << 30, None)])
def test_compaction_joined_and_in_one_task(spark, monkeypatch, few, max_rounds):
    monkeypatch.setattr(compaction, "FEW", few)
    ext, sim, k = graph_and_simulator(spark, 6)
    rounds, partial = [], []
    while len(sim.nodes) > 5 and (max_rounds is None or len(rounds) < max_rounds):
        *r, contigs = sim.round()
        rounds.append(tuple(r))
        partial += contigs
    seconds = []
    left, found, got = compaction.compact(ext, k, 5, max_rounds, seconds)
    assert got == rounds and len(seconds) == len(rounds) > 2
    assert sorted(r.contig for r in found.collect()) == sorted(partial)
    order = lambda e: (e[1], e[0], -e[3], -e[2])
    want = [(node, side, *e[:4], i) for node, sides in sim.nodes.items() for side in "PS" for i, e in enumerate(sorted(sides[side], key=order))]
    assert sorted(tuple(r) for r in left.select("node", "side", "ext", "terminal", "cnt", "visit", "ext_id").collect()) == sorted(want)


@pytest.mark.parametrize("name", ["round_figures", "partial_contigs"])
def test_no_walk_unless_asked_for(spark, monkeypatch, name):
    monkeypatch.setattr(assembly, "walk", lambda *a: pytest.fail("walked"))
    monkeypatch.setattr(queries, "reads", lambda s, d: frame(s, random_reads(2)))
    monkeypatch.setattr(queries, "COMPACTED", AssemblyConfig(k=6, l=2, coverage=2, cutoff=2, node_threshold=6))
    queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", ["contig_records", "contig_lengths"])
def test_long_contigs_take_few_jobs(spark, monkeypatch, name):
    rng = random.Random(7)
    text = "".join(rng.choice("ACTG") for _ in range(1200))
    monkeypatch.setattr(queries, "reads", lambda s, d: frame(s, [text] * 3))
    spark.sparkContext.setJobGroup(f"long {name}", "")
    got = [tuple(r) for r in queries.QUERIES[name](spark, SF).collect()]
    spark.sparkContext.setJobGroup("", "")
    assert len(got) == 1 and (got[0][1] == text if name == "contig_records" else got == [(1200, 1)])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"long {name}")) < 100


@pytest.mark.parametrize("k", [20, 21, 32])
def test_packed_super_kmers(monkeypatch, k):
    """Counts of k-mers and their histogram, whatever is sorted at once and however rows come; reads of any length and letters."""
    rng = random.Random(k)
    seqs = ["".join(rng.choice("0123") for _ in range(n)) for n in (0, k - 1, k, 300, 900, 40, 40)] + ["0" * 500, "01" * 90, "01230123N" + "0123" * 20]
    seqs += [seqs[4] * 2, *seqs[3:6] * 2]
    want = Counter(w for s in seqs for i in range(len(s) - k + 1) if "N" not in (w := s[i : i + k]))
    for most, chunk, size in ((1 << 20, 1 << 20, 1000), (50, 1 << 20, 3), (50, 64, 1000), (300, 200, 7)):
        monkeypatch.setattr(superkmers, "MOST", most)
        monkeypatch.setattr(superkmers, "CHUNK", chunk)
        packed = pa.Table.from_batches(superkmers.packed_super_kmers(k, 12)(iter([pa.record_batch([pa.array([*seqs, None])], names=["_seq"])]))).sort_by("bucket").combine_chunks()
        rows = [tuple(r.values()) for b in superkmers.counted(k, 2, 4)(iter(packed.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted((w, c) for w, c, _ in rows if w) == sorted((w, c) for w, c in want.items() if c > 1)
        assert [(c, n) for w, c, n in rows if w is None] == [(0, 2), *((c, sum(x == c for x in want.values())) for c in (1, 2, 3))]


@pytest.mark.parametrize("k, least, floor", [(31, None, None), (31, None, 9), (31, 3, None), (40, None, None)])
def test_solid_kmers_of_reads(spark, monkeypatch, k, least, floor):
    """As from all counts; also where the cutoff is lower than tasks took it to be."""
    monkeypatch.setattr(kmers, "counted", lambda k, least, buckets: superkmers.counted(k, floor if least is None else least, buckets))
    rng = random.Random(k)
    seqs = [s for n in (1, 2, 4, 4, 6, 12) for s in ["".join(rng.choice("ACGT") for _ in range(60 + n))] * n]
    found = kmers.counts(frame(spark, seqs), k)
    want = kmers.solid(found, least or kmers.cutoff(kmers.histogram(found, 7)).first()["cutoff"])
    got = sorted(tuple(r) for r in kmers.solid_of(frame(spark, seqs), k, least, 7).collect())
    assert got == sorted(tuple(r) for r in want.collect()) and len({c for _, c in got}) > 1


@pytest.mark.parametrize("name", ["contig_records", "contig_lengths"])
def test_only_solid_kmers_are_written(spark, monkeypatch, name):
    """50,000 k-mers that occur once are in no table."""
    rng = random.Random(8)
    text, *rest = ("".join(rng.choice("ACTG") for _ in range(n)) for n in [1200] + [200] * 300)
    monkeypatch.setattr(queries, "reads", lambda s, d: frame(s, [text] * 3 + rest))
    paths, write = [], tables.write
    monkeypatch.setattr(tables, "write", lambda df, path: (write(df, path), paths.append(spark.read.parquet(path).count())))
    got = [tuple(r) for r in queries.QUERIES[name](spark, SF).collect()]
    assert len(got) == 1 and (got[0][1] == text if name == "contig_records" else got == [(1200, 1)])
    assert paths and max(paths) < 10_000


def test_memory_of_a_walk_at_once():
    """Edges of FEW bytes take 400 MB at most."""
    n, k = 20_000, 32
    names = [f"{i:031d}" for i in range(n)]
    edges = pa.table({
        "node": names, "p_id": pa.array([1] * n, pa.int32()), "start": [0] * n, "size": [1] * n, "off_s": [0] * n, "s_ext": ["1"] * n, "done": [i == n - 1 for i in range(n)],
        "next_node": [*names[1:], None], "next_p": pa.array([1] * (n - 1) + [None], pa.int32()),
    })
    begin = pa.table([pa.array([x], f.type) for x, f in zip((names[0], 1, None, 1, None, "0", False, None, None), edges.schema)], schema=edges.schema)
    batches = [*edges.to_batches(max_chunksize=1000), *begin.to_batches()]
    tracemalloc.start()
    got = [c for b in small.walks("reference", 1 << 20)(iter(batches)) for c in b.column(0).to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == ["0" + "1" * n]
    assert most / (n * (2 * k + 101)) * walk.FEW < 400e6
