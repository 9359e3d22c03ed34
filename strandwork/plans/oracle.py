"""The library's queries in SQL, for another engine on the same tables: written from the definitions, not from the
plans. Pieces are common table expressions that build on each other."""

from __future__ import annotations

from ..functions.encoding import BASES, LETTER_BASES, LOWER

_DIGITS = "".join(str(BASES.index(b)) for b in LETTER_BASES)
COVERAGE, BUCKETS, K, L = 10, 21, 32, 8

READS = f"""reads AS (
  SELECT doc_id AS read_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{LOWER}', '{_DIGITS}') AS s FROM documents
)"""


def windows(k: int, name: str, count: str) -> str:
    return f"""{name}s AS (
  SELECT substr(s, i, {k}) AS {name}, count(*)::BIGINT AS {count} FROM (SELECT s, unnest(range(1, length(s) - {k} + 2)) AS i FROM reads WHERE length(s) >= {k}) GROUP BY 1
)"""


KMERS = f"{READS}, {windows(K, 'kmer', 'cnt')}"
LMERS = f"{READS}, {windows(L, 'lmer', 'freq')}"
HISTOGRAM = f"""{KMERS}, histogram AS (
  SELECT b.bucket, coalesce(h.n, 0)::BIGINT AS n FROM (SELECT unnest(range(1, {BUCKETS})) AS bucket) b
  LEFT JOIN (SELECT cnt, count(*) AS n FROM kmers GROUP BY cnt) h ON h.cnt = b.bucket
)"""
SOLID = f"""{HISTOGRAM}, least AS (SELECT bucket AS cutoff, n FROM histogram ORDER BY n, bucket LIMIT 1),
solid AS (SELECT kmer, cnt FROM kmers WHERE cnt >= (SELECT cutoff FROM least))"""
EXT = f"""{SOLID}, plain AS (
  SELECT substr(kmer, 1, {K - 1}) AS node, 'S' AS side, substr(kmer, {K}, 1) AS ext, false AS terminal, cnt, ceil(cnt / {COVERAGE}.0)::BIGINT AS visit FROM solid
  UNION ALL
  SELECT substr(kmer, 2, {K - 1}), 'P', substr(kmer, 1, 1), false, cnt, ceil(cnt / {COVERAGE}.0)::BIGINT FROM solid
), balance AS (
  SELECT node, sum(CASE WHEN side = 'P' THEN visit ELSE 0 END)::BIGINT AS p_visit, sum(CASE WHEN side = 'S' THEN visit ELSE 0 END)::BIGINT AS s_visit FROM plain GROUP BY node
), nodes_ext AS (
  SELECT * FROM plain
  UNION ALL SELECT node, 'P', '', true, 1, greatest(s_visit - p_visit, 0) FROM balance
  UNION ALL SELECT node, 'S', '', true, 1, greatest(p_visit - s_visit, 0) FROM balance
), ext AS (
  SELECT *, (row_number() OVER (PARTITION BY node, side ORDER BY ext) - 1)::INTEGER AS ext_id FROM nodes_ext
), near AS (
  SELECT *, CASE WHEN side = 'P' THEN substr(ext || node, 1, {K - 1}) ELSE right(node || ext, {K - 1}) END AS neighbor,
    CASE WHEN side = 'P' THEN substr(ext || node, {K}) ELSE left(node || ext, length(node || ext) - {K - 1}) END AS back FROM ext
)"""
WIRES = f"""{EXT}, placed AS (
  SELECT *, sum(visit) OVER (PARTITION BY node, side ORDER BY visit DESC, cnt DESC, terminal, length(ext), ext, ext_id ROWS UNBOUNDED PRECEDING) AS hi FROM ext WHERE visit > 0
), wires AS (
  SELECT p.node, p.ext_id AS p_id, s.ext_id AS s_id, (greatest(p.hi - p.visit, s.hi - s.visit) - (p.hi - p.visit))::BIGINT AS off_p,
    (greatest(p.hi - p.visit, s.hi - s.visit) - (s.hi - s.visit))::BIGINT AS off_s, (least(p.hi, s.hi) - greatest(p.hi - p.visit, s.hi - s.visit))::BIGINT AS cnt
  FROM placed p JOIN placed s ON p.node = s.node WHERE p.side = 'P' AND s.side = 'S' AND p.hi - p.visit < s.hi AND s.hi - s.visit < p.hi
)"""
CHOSEN = f"""{WIRES}, chosen AS (
  SELECT node FROM near GROUP BY node HAVING max(CASE WHEN terminal THEN NULL ELSE neighbor END) IS NULL OR max(CASE WHEN terminal THEN NULL ELSE neighbor END) <= node
)"""
MESSAGES = f"""{CHOSEN}, through AS (
  SELECT w.node, w.cnt AS flow, p.ext AS p_ext, p.terminal AS p_end, p.cnt AS p_cnt, p.neighbor AS p_to, p.back AS p_back,
    s.ext AS s_ext, s.terminal AS s_end, s.cnt AS s_cnt, s.neighbor AS s_to, s.back AS s_back
  FROM wires w JOIN chosen c ON w.node = c.node
  JOIN near p ON p.node = w.node AND p.side = 'P' AND p.ext_id = w.p_id JOIN near s ON s.node = w.node AND s.side = 'S' AND s.ext_id = w.s_id
), messages AS (
  SELECT p_to AS search_mn, p_back AS search_ext, s_ext AS mn_ext, least(p_cnt, s_cnt) AS cnt, flow AS visit, s_end OR s_to = node AS terminal, 'P' AS direction
  FROM through WHERE NOT p_end AND p_to <> node
  UNION ALL
  SELECT s_to, s_back, p_ext, least(p_cnt, s_cnt), flow, p_end OR p_to = node, 'S' FROM through WHERE NOT s_end AND s_to <> node
)"""
WALK = f"""{WIRES}, edges AS (
  SELECT w.node, w.p_id, w.off_p AS start, w.cnt AS size, w.off_s, s.ext AS s_ext, s.terminal AS done, s.neighbor AS next_node,
    (SELECT min(p.ext_id) FROM ext p WHERE p.node = s.neighbor AND p.side = 'P' AND p.ext = s.back) AS next_p
  FROM wires w JOIN near s ON s.node = w.node AND s.side = 'S' AND s.ext_id = w.s_id
), walk AS (
  SELECT node, ext_id AS p_id, 0::BIGINT AS o, visit AS f, ext || node AS contig, false AS done FROM ext WHERE side = 'P' AND terminal AND visit > 0
  UNION ALL
  SELECT e.next_node, e.next_p, e.off_s + greatest(w.o, e.start) - e.start, least(w.o + w.f, e.start + e.size) - greatest(w.o, e.start), w.contig || e.s_ext, e.done
  FROM walk w JOIN edges e ON e.node = w.node AND e.p_id = w.p_id
  WHERE NOT w.done AND e.start + e.size > w.o AND (e.start <= w.o OR 2 * (e.start - w.o) <= w.f)
)"""
_LMER_VALUE = " + ".join(f"substr(lmer, {i + 1}, 1)::BIGINT * {4 ** (L - 1 - i)}" for i in range(L))
_MIN_VALUE = _LMER_VALUE.replace("lmer", "minimizer")
_HASH = "((((68111 * {v} + 105929) >> 31) + (68111 * {v} + 105929)) & 2147483647)"
MINIMIZERS = f"""{SOLID}, {windows(L, 'lmer', 'freq')}, parts AS (
  SELECT kmer, i, substr(kmer, i, {L}) AS lmer FROM (SELECT kmer, unnest(range(1, {K - L + 2})) AS i FROM solid)
), minimizers AS (
  SELECT kmer, lmer AS minimizer FROM (SELECT kmer, lmer, row_number() OVER (PARTITION BY kmer ORDER BY freq, i) AS n FROM parts JOIN lmers USING (lmer)) WHERE n = 1
)"""
_CELLS = ", ".join(f"sum(CASE WHEN side = '{s}' AND ext = '{b}' THEN cnt ELSE 0 END)::BIGINT AS {s.lower()}{b}" for s in "PS" for b in "0123")

#: Compaction as the queries have it: cutoff, node threshold; and rounds that are written out (those after the last do
#: nothing).
CUTOFF, THRESHOLD, ROUNDS = 5, 500, 14


def _near(i: int) -> str:
    return f"""near{i} AS MATERIALIZED (
  SELECT *, CASE WHEN side = 'P' THEN substr(ext || node, 1, {K - 1}) ELSE right(node || ext, {K - 1}) END AS neighbor,
    CASE WHEN side = 'P' THEN substr(ext || node, {K}) ELSE left(node || ext, length(node || ext) - {K - 1}) END AS back FROM ext{i}
)"""


def _wires(i: int, nodes: str) -> str:
    return f"""placed{i} AS MATERIALIZED (
  SELECT *, sum(visit) OVER (PARTITION BY node, side ORDER BY visit DESC, cnt DESC, terminal, length(ext), ext, ext_id ROWS UNBOUNDED PRECEDING) AS hi FROM near{i} WHERE visit > 0 AND {nodes}
), wires{i} AS MATERIALIZED (
  SELECT p.node, p.ext_id AS p_id, s.ext_id AS s_id, greatest(p.hi - p.visit, s.hi - s.visit) - (p.hi - p.visit) AS off_p,
    greatest(p.hi - p.visit, s.hi - s.visit) - (s.hi - s.visit) AS off_s, (least(p.hi, s.hi) - greatest(p.hi - p.visit, s.hi - s.visit))::BIGINT AS cnt
  FROM placed{i} p JOIN placed{i} s ON p.node = s.node WHERE p.side = 'P' AND s.side = 'S' AND p.hi - p.visit < s.hi AND s.hi - s.visit < p.hi
)"""


def _round(i: int) -> str:
    """Round i, from ext{i} to ext{i + 1}."""
    grown = "CASE WHEN direction = 'P' THEN search_ext || mn_ext ELSE mn_ext || search_ext END"
    other = "CASE WHEN direction = 'P' THEN 'S' ELSE 'P' END"
    return f"""{_near(i)}, size{i} AS MATERIALIZED (SELECT count(DISTINCT node) AS n FROM ext{i}), chosen{i} AS MATERIALIZED (
  SELECT node FROM near{i} GROUP BY node HAVING coalesce(max(CASE WHEN terminal THEN NULL ELSE neighbor END) <= node, true) AND (SELECT n FROM size{i}) > {THRESHOLD}
), {_wires(i, f"node IN (SELECT node FROM chosen{i})")}, through{i} AS MATERIALIZED (
  SELECT w.node, w.cnt AS flow, p.ext AS p_ext, p.terminal AS p_end, p.cnt AS p_cnt, p.neighbor AS p_to, p.back AS p_back,
    s.ext AS s_ext, s.terminal AS s_end, s.cnt AS s_cnt, s.neighbor AS s_to, s.back AS s_back
  FROM wires{i} w JOIN near{i} p ON p.node = w.node AND p.side = 'P' AND p.ext_id = w.p_id JOIN near{i} s ON s.node = w.node AND s.side = 'S' AND s.ext_id = w.s_id
), messages{i} AS MATERIALIZED (
  SELECT p_to AS search_mn, p_back AS search_ext, s_ext AS mn_ext, least(p_cnt, s_cnt) AS cnt, flow AS visit, s_end OR s_to = node AS terminal, 'P' AS direction
  FROM through{i} WHERE NOT p_end AND p_to <> node
  UNION ALL SELECT s_to, s_back, p_ext, least(p_cnt, s_cnt), flow, p_end OR p_to = node, 'S' FROM through{i} WHERE NOT s_end AND s_to <> node
), named{i} AS MATERIALIZED (
  SELECT DISTINCT search_mn AS node, {other} AS side, search_ext AS ext FROM messages{i}
), every{i} AS (
  SELECT e.node, e.side, e.ext, e.terminal, e.cnt, e.visit FROM (SELECT *, row_number() OVER (PARTITION BY node, side, ext, terminal ORDER BY ext_id) AS nth FROM ext{i}) e
  LEFT JOIN chosen{i} c ON c.node = e.node LEFT JOIN named{i} m ON m.node = e.node AND m.side = e.side AND m.ext = e.ext AND NOT e.terminal
  WHERE c.node IS NULL AND (m.node IS NULL OR nth > 1)
  UNION ALL SELECT search_mn, {other}, {grown}, terminal, cnt, visit FROM messages{i}
), ext{i + 1} AS MATERIALIZED (
  SELECT *, (row_number() OVER (PARTITION BY node, side ORDER BY terminal, ext, visit DESC, cnt DESC) - 1)::INTEGER AS ext_id FROM every{i} WHERE (SELECT n FROM size{i}) > {THRESHOLD}
  UNION ALL SELECT node, side, ext, terminal, cnt, visit, ext_id FROM ext{i} WHERE (SELECT n FROM size{i}) <= {THRESHOLD}
)"""


_BUILD = f"""{KMERS}, solid AS (SELECT kmer, cnt FROM kmers WHERE cnt >= {CUTOFF})""" + EXT[len(SOLID) : EXT.index(", near AS")]
ROUNDS_SQL = ", ".join([_BUILD, "ext0 AS MATERIALIZED (SELECT * FROM ext)", *[_round(i) for i in range(ROUNDS)]])
_PARTIAL = " UNION ALL ".join(f"SELECT p_ext || node || s_ext AS contig FROM through{i} WHERE p_end AND s_end" for i in range(ROUNDS))
CONTIGS = f"""{ROUNDS_SQL}, {_near(ROUNDS)}, {_wires(ROUNDS, "true")}, edges AS MATERIALIZED (
  SELECT w.node, w.p_id, w.off_p AS start, w.cnt AS size, w.off_s, s.ext AS s_ext, s.terminal AS done, s.neighbor AS next_node, f.next_p
  FROM wires{ROUNDS} w JOIN near{ROUNDS} s ON s.node = w.node AND s.side = 'S' AND s.ext_id = w.s_id
  LEFT JOIN (SELECT node, ext, min(ext_id) AS next_p FROM ext{ROUNDS} WHERE side = 'P' GROUP BY node, ext) f ON f.node = s.neighbor AND f.ext = s.back
), walk AS (
  SELECT node, ext_id AS p_id, 0::BIGINT AS o, visit AS f, ext || node AS contig, false AS done FROM ext{ROUNDS} WHERE side = 'P' AND terminal AND visit > 0
  UNION ALL
  SELECT e.next_node, e.next_p, (e.off_s + greatest(w.o, e.start) - e.start)::BIGINT, (least(w.o + w.f, e.start + e.size) - greatest(w.o, e.start))::BIGINT, w.contig || e.s_ext, e.done
  FROM walk w JOIN edges e ON e.node = w.node AND e.p_id = w.p_id
  WHERE NOT w.done AND e.start + e.size > w.o AND (e.start <= w.o OR 2 * (e.start - w.o) <= w.f)
), partial AS ({_PARTIAL}), contigs AS (
  SELECT contig, 'walk' AS source FROM walk WHERE done UNION ALL SELECT contig, 'partial' FROM partial
)"""
_ROUND_ROWS = " UNION ALL ".join(f"SELECT {i + 1} AS round, (SELECT n FROM size{i}) AS n_nodes, (SELECT count(*) FROM chosen{i}) AS n_chosen, (SELECT count(*) FROM messages{i}) AS n_messages" for i in range(ROUNDS))
_FIGURES = f"figures AS (SELECT * FROM ({_ROUND_ROWS}) WHERE n_nodes > {THRESHOLD})"
_SIDE = "coalesce(string_agg(ext || CASE WHEN terminal THEN '$' ELSE '' END || ':' || cnt || ':' || visit, ',' ORDER BY ext_id) FILTER (WHERE side = '{side}'), '')"

SQL: dict[str, str] = {
    "read_stats": f"WITH {READS} SELECT count(*) AS n_reads, sum(length(s))::BIGINT AS n_bases, min(length(s))::BIGINT AS min_len, max(length(s))::BIGINT AS max_len, sum(greatest(length(s) - {K - 1}, 0))::BIGINT AS n_kmers FROM reads",
    "kmers_per_read": f"WITH {READS} SELECT read_id, greatest(length(s) - {K - 1}, 0)::BIGINT AS n_kmers FROM reads",
    "base_counts": f"WITH {READS} SELECT substr('{BASES}', c + 1, 1) AS base, count(*) AS n FROM (SELECT substr(s, i, 1)::INTEGER AS c FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM reads)) GROUP BY 1",
    "lmer_freq": f"WITH {LMERS} SELECT translate(lmer, '0123', '{BASES}') AS lmer, freq FROM lmers",
    "streaming_lmer_freq": f"WITH {LMERS} SELECT translate(lmer, '0123', '{BASES}') AS lmer, freq FROM lmers",
    "kmer_counts": f"WITH {KMERS} SELECT translate(kmer, '0123', '{BASES}') AS kmer, cnt FROM kmers",
    "kmer_totals": f"WITH {KMERS} SELECT count(*) AS n_distinct, sum(cnt)::BIGINT AS n_total, min(cnt) AS min_cnt, max(cnt) AS max_cnt FROM kmers",
    "kmer_histogram": f"WITH {HISTOGRAM} SELECT bucket, n FROM histogram",
    "abundance_cutoff": f"WITH {SOLID} SELECT cutoff, n FROM least",
    "solid_kmers": f"WITH {SOLID} SELECT translate(kmer, '0123', '{BASES}') AS kmer, cnt FROM solid",
    "minimizers": f"WITH {MINIMIZERS} SELECT translate(kmer, '0123', '{BASES}') AS kmer, translate(minimizer, '0123', '{BASES}') AS minimizer FROM minimizers",
    "minimizer_load": f"WITH {MINIMIZERS}, valued AS (SELECT m.kmer, s.cnt, {_MIN_VALUE} AS v FROM minimizers m JOIN solid s ON m.kmer = s.kmer) SELECT {_HASH.format(v='v')} % 16 AS partition, count(*) AS n_kmers, sum(cnt)::BIGINT AS n_instances FROM valued GROUP BY 1",
    "hash31_partition_load": f"WITH {LMERS}, valued AS (SELECT freq, {_LMER_VALUE} AS v FROM lmers) SELECT {_HASH.format(v='v')} % 16 AS partition, count(*) AS n_kmers, sum(freq)::BIGINT AS n_instances FROM valued GROUP BY 1",
    "range_partition_load": f"WITH {LMERS}, valued AS (SELECT freq, {_LMER_VALUE} AS v FROM lmers) SELECT least(15, v // {(4**L - 1) // 16}) AS partition, count(*) AS n_kmers, sum(freq)::BIGINT AS n_instances FROM valued GROUP BY 1",
    "node_extensions": f"WITH {EXT} SELECT node, side, ext, terminal, cnt, visit, ext_id FROM ext",
    "macro_nodes": f"WITH {EXT} SELECT node, count(*) FILTER (WHERE side = 'P' AND NOT terminal) AS n_prefixes, count(*) FILTER (WHERE side = 'S' AND NOT terminal) AS n_suffixes FROM ext GROUP BY node",
    "base_pivot": f"WITH {EXT} SELECT node, {_CELLS} FROM ext GROUP BY node",
    "threshold_nodes": f"WITH {EXT} SELECT node FROM ext WHERE NOT terminal GROUP BY node HAVING max(cnt) >= 30",
    "neighbors": f"WITH {EXT} SELECT node, side, ext, neighbor, back FROM near WHERE NOT terminal",
    "node_balance": f"WITH {EXT} SELECT node, p_visit, s_visit, greatest(s_visit - p_visit, 0) AS null_p, greatest(p_visit - s_visit, 0) AS null_s FROM balance",
    "wires": f"WITH {WIRES} SELECT * FROM wires",
    "wire_invariants": f"""WITH {WIRES}, sides AS (
  SELECT node, sum(CASE WHEN side = 'P' THEN visit ELSE 0 END) AS p, sum(CASE WHEN side = 'S' THEN visit ELSE 0 END) AS s FROM ext GROUP BY node
) SELECT count(*) AS n_nodes, sum(CASE WHEN p <> s THEN 1 ELSE 0 END)::BIGINT AS n_unbalanced, sum(p)::BIGINT AS n_visits,
  (SELECT count(*) FROM wires) AS n_wires, (SELECT sum(cnt) FROM wires)::BIGINT AS n_wired FROM sides""",
    "independent_set": f"WITH {CHOSEN} SELECT node FROM chosen",
    "transfers_round1": f"WITH {MESSAGES} SELECT * FROM messages",
    "partial_contigs_round1": f"WITH {MESSAGES} SELECT p_ext || node || s_ext AS contig FROM through WHERE p_end AND s_end",
    "compact_round1": f"""WITH {MESSAGES}, named AS (
  SELECT DISTINCT search_mn AS node, CASE WHEN direction = 'P' THEN 'S' ELSE 'P' END AS side, search_ext AS ext FROM messages
), kept AS (
  SELECT e.* FROM (SELECT *, row_number() OVER (PARTITION BY node, side, ext, terminal ORDER BY ext_id) AS nth FROM ext) e
  LEFT JOIN chosen c ON c.node = e.node LEFT JOIN named m ON m.node = e.node AND m.side = e.side AND m.ext = e.ext AND NOT e.terminal
  WHERE c.node IS NULL AND (m.node IS NULL OR nth > 1)
) SELECT node, side, ext, terminal, cnt, visit FROM kept
UNION ALL SELECT search_mn, CASE WHEN direction = 'P' THEN 'S' ELSE 'P' END, CASE WHEN direction = 'P' THEN search_ext || mn_ext ELSE mn_ext || search_ext END, terminal, cnt, visit FROM messages""",
    "begin_nodes": f"WITH {EXT} SELECT node, ext, ext_id, visit FROM ext WHERE side = 'P' AND terminal AND visit > 0",
    "walk_contigs": f"WITH RECURSIVE {WALK} SELECT translate(contig, '0123', '{BASES}') AS contig FROM walk WHERE done",
    "contig_lengths": f"WITH RECURSIVE {WALK} SELECT length(contig) AS len, count(*) AS n FROM walk WHERE done GROUP BY 1",
    "sorted_keys": "SELECT DISTINCT l_partkey FROM lineitem ORDER BY 1",
    "most_significant_bit": "SELECT ((length(bin(max(o_orderkey))) - 1) // 8)::INTEGER AS byte_index, ((length(bin(max(o_orderkey))) - 1) % 8)::INTEGER AS bit_index FROM orders",
    "byte_shuffle_load": "SELECT least((o_orderkey & 255) // 64, 3)::INTEGER AS processor, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1",
    "assembly_compacted": f"WITH RECURSIVE {CONTIGS} SELECT translate(contig, '0123', '{BASES}') AS contig, length(contig)::INTEGER AS len, source FROM contigs",
    "partial_contigs": f"WITH {ROUNDS_SQL}, partial AS ({_PARTIAL}) SELECT translate(contig, '0123', '{BASES}') AS contig FROM partial",
    "compacted_graph": f"WITH {ROUNDS_SQL} SELECT node, side, ext, terminal, cnt, visit, ext_id FROM ext{ROUNDS}",
    "round_figures": f"WITH {ROUNDS_SQL}, {_FIGURES} SELECT round::INTEGER AS round, n_nodes, n_chosen, n_messages FROM figures",
    "assembly_stats": f"""WITH RECURSIVE {CONTIGS}, {_FIGURES} SELECT {CUTOFF}::BIGINT AS cutoff, (SELECT count(*) FROM figures) AS n_rounds, (SELECT count(*) FROM kmers) AS n_distinct,
  (SELECT sum(cnt) FROM kmers)::BIGINT AS n_total, (SELECT count(DISTINCT node) FROM ext0) AS n_nodes, (SELECT count(DISTINCT node) FROM ext{ROUNDS}) AS n_left,
  count(*) FILTER (WHERE source = 'walk') AS n_walk, count(*) FILTER (WHERE source = 'partial') AS n_partial, max(length(contig)) AS longest FROM contigs""",
    "node_dump": f"WITH {EXT} SELECT node, {_SIDE.format(side='P')} AS prefixes, {_SIDE.format(side='S')} AS suffixes FROM ext GROUP BY node",
    "fasta_reads": f"WITH {READS} SELECT 'doc_' || read_id AS header, translate(s, '0123', '{BASES}') AS seq FROM reads WHERE length(s) > 0",
    "fasta_totals": f"WITH {KMERS} SELECT count(*) AS n_distinct, sum(cnt)::BIGINT AS n_total, min(cnt) AS min_cnt, max(cnt) AS max_cnt FROM kmers",
    "delimited_records": "SELECT c_name AS record FROM customer UNION ALL SELECT c_mktsegment FROM customer",
    "contig_records": f"""WITH RECURSIVE {WALK} SELECT 'contig_' || substr(sha256(contig), 1, 16) || '_l_' || length(contig) || '_walk' AS header, translate(contig, '0123', '{BASES}') AS seq
FROM walk WHERE done AND length(contig) > 33""",
    "log_figures": """SELECT n_nationkey AS round, 'Itr' AS label, n_nationkey::DOUBLE AS value FROM nation
UNION ALL SELECT n_nationkey, 'Total number of macro_nodes across all proc''s', 1000 - n_nationkey FROM nation
UNION ALL SELECT NULL, 'Total number of reads', sum(n_nationkey) FROM nation GROUP BY n_regionkey
UNION ALL SELECT DISTINCT NULL::INTEGER, '[elapsed-time-no-io]', n_regionkey + 0.25 FROM nation""",
    "log_runs": """SELECT sum(n_nationkey)::DOUBLE AS n_reads, NULL::DOUBLE AS n_processes, NULL::DOUBLE AS n_distinct, NULL::DOUBLE AS counting_s, (n_regionkey + 0.25)::DOUBLE AS elapsed_s,
(1000 - min(n_nationkey))::DOUBLE AS first_nodes, (1000 - max(n_nationkey))::DOUBLE AS last_nodes, max(n_nationkey) AS n_rounds FROM nation GROUP BY n_regionkey""",
    "lmer_functions": f"""WITH {LMERS}, t AS (SELECT translate(lmer, '0123', '{BASES}') AS lmer FROM lmers)
SELECT lmer, ((ascii(lmer) >> 1) & 7)::INTEGER AS code, substr(lmer, 2) || 'G' AS shifted, substr(lmer, 3, 1) AS third, lmer AS strict FROM t""",
    "lenient_bases": "SELECT n_name, regexp_replace(upper(n_name), '[^ACGT]', 'A', 'g') AS bases, ((ascii(n_name) >> 1) & 7)::INTEGER AS code FROM nation",
}
