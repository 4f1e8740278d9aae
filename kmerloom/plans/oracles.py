"""DuckDB SQL for the registered queries: an independent statement of each, window by window and without shortcuts."""

from __future__ import annotations

K, PARTS, CHUNK, FILE_IDS, RANGE = 27, 16, 1000, 8192, 1 << 16
_BASES = "regexp_replace(translate(regexp_replace(lower(text), '[^\\p{L}]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'N', 'g')"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"


def _bucket(kmer: str) -> str:
    return "CAST(" + " + ".join(f"(instr('ACGT', substr({kmer}, {i + 1}, 1)) - 1) * {4 ** (9 - i)}" for i in range(10)) + " AS INTEGER)"


_SEQS = f"seqs AS (SELECT doc_id, {_BASES} AS s FROM documents WHERE text IS NOT NULL)"
_CUT = "(SELECT doc_id, s, (length(s) + 59) // 60 AS n, unnest(range((length(s) + 59) // 60)) AS o FROM seqs)"
_F1 = f"""{_SEQS},
reads AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, o) - 1 AS read_id, CAST(NULL AS BIGINT) AS mate_id, doc_id, substr(s, CAST(o * 60 + 1 AS BIGINT), 100) AS seq FROM {_CUT})"""
_F2 = f"""{_SEQS},
reads AS MATERIALIZED (SELECT read_id, CASE WHEN o % 2 = 1 THEN read_id - 1 WHEN o + 1 < n THEN read_id + 1 END AS mate_id, doc_id, seq FROM (
  SELECT row_number() OVER (ORDER BY doc_id, o) - 1 AS read_id, doc_id, o, n, substr(s, CAST(o * 60 + 1 AS BIGINT), 100) AS seq FROM {_CUT}))"""
_F3 = f"""turned AS (SELECT conv_id, turn // 2 AS j, turn, {_BASES.replace("(text)", "(coalesce(text, ''))")} AS seq, row_number() OVER (ORDER BY conv_id, turn) - 1 AS read_id FROM conversations),
paired AS (SELECT *, count(*) OVER w AS n, min(turn) OVER w < max(turn) OVER w AS two, min(read_id) OVER w + max(read_id) OVER w - read_id AS other FROM turned WINDOW w AS (PARTITION BY conv_id, j)),
reads AS MATERIALIZED (SELECT read_id, CASE WHEN n = 2 AND two THEN other END AS mate_id, seq FROM paired)"""

_OCC = f"""windows AS (SELECT read_id, i, length(seq) - {K} AS last, substr(seq, i + 1, {K}) AS f,
    CASE WHEN i = 0 THEN 'N' ELSE substr(seq, i, 1) END AS p, CASE WHEN i + {K} = length(seq) THEN 'N' ELSE substr(seq, i + {K + 1}, 1) END AS n
  FROM (SELECT read_id, seq, unnest(range(length(seq) - {K - 1})) AS i FROM reads WHERE length(seq) > {K})),
strands AS (SELECT *, {_RC.format("f")} AS b FROM windows WHERE f NOT LIKE '%N%'),
occ AS MATERIALIZED (SELECT read_id, i, last, least(f, b) AS kmer, CASE WHEN f < b THEN p ELSE translate(n, 'ACGT', 'TGCA') END AS pv,
    CASE WHEN f < b THEN n ELSE translate(p, 'ACGT', 'TGCA') END AS nx FROM strands)"""

_MIN3 = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY i) AS j FROM occ),
fold AS (SELECT read_id, CAST(0 AS BIGINT) AS j, CAST((length(seq) - {K}) // 3 AS BIGINT) AS until, CAST(NULL AS VARCHAR) AS kmer, CAST(NULL AS VARCHAR) AS pv, CAST(NULL AS VARCHAR) AS nx,
    CAST(NULL AS VARCHAR) AS out_kmer, CAST(NULL AS VARCHAR) AS out_pv, CAST(NULL AS VARCHAR) AS out_nx FROM reads WHERE length(seq) > {K}
  UNION ALL
  SELECT o.read_id, o.j,
    CASE WHEN o.i <= f.until THEN f.until WHEN f.until + 2 * (o.last // 3) > o.last THEN o.last ELSE f.until + o.last // 3 END,
    CASE WHEN take THEN real ELSE f.kmer END, CASE WHEN take THEN o.pv ELSE f.pv END, CASE WHEN take THEN o.nx ELSE f.nx END,
    CASE WHEN o.i > f.until THEN f.kmer END, f.pv, f.nx
  FROM fold f JOIN (SELECT *, CASE WHEN kmer <> repeat('A', {K}) THEN kmer END AS real FROM placed) o ON o.read_id = f.read_id AND o.j = f.j + 1,
  LATERAL (SELECT o.i > f.until OR f.kmer IS NULL OR coalesce(o.real < f.kmer, false) AS take)),
mins AS (SELECT read_id, out_kmer AS kmer, out_pv AS pv, out_nx AS nx FROM fold WHERE out_kmer IS NOT NULL
  UNION ALL SELECT f.read_id, kmer, pv, nx FROM fold f JOIN (SELECT read_id, max(j) AS j FROM fold GROUP BY read_id) USING (read_id, j) WHERE kmer IS NOT NULL)"""


def _side(name: str, column: str) -> str:
    n = {c: f"count(*) FILTER ({column} = '{c}')" for c in "ACTG"}
    most = f"greatest({', '.join(n.values())})"
    top = " ".join(f"WHEN {n[c]} = {most} THEN '{c}'" for c in "ACTG")
    return f"""CAST({' + '.join(f'CAST({x} > 0 AS INTEGER)' for x in n.values())} AS INTEGER) AS n_{name},
    CASE WHEN {most} = 0 THEN NULL {top} END AS top_{name}, list_reverse_sort([{', '.join(n.values())}])[2] AS s_{name}"""


def _groups(occ: str = "occ") -> str:
    return f"groups AS (SELECT kmer, count(*) AS deg, max(read_id) AS last_read, {_side('prev', 'pv')}, {_side('next', 'nx')} FROM {occ} GROUP BY kmer)"


def _edges(occ: str = "occ", degree: str = "true") -> str:
    return f"""bad AS (SELECT DISTINCT o.read_id FROM {occ} o JOIN groups USING (kmer) WHERE (n_prev > 1) <> (n_next > 1)
    AND CASE WHEN n_prev > 1 THEN o.pv <> top_prev OR 5 * s_prev >= deg ELSE o.nx <> top_next OR 5 * s_next >= deg END),
surviving AS (SELECT DISTINCT kmer, read_id FROM {occ} JOIN groups USING (kmer) WHERE NOT (n_prev > 1 AND n_next > 1) AND kmer <> repeat('A', {K}) AND {degree}
    AND read_id NOT IN (SELECT read_id FROM bad)),
edges AS (SELECT DISTINCT u, v FROM (SELECT max(read_id) OVER (PARTITION BY kmer) AS u, read_id AS v FROM surviving) WHERE u <> v)"""


def _components(edges: str = "edges", out: str = "comps") -> str:
    return f"""{out}_both AS MATERIALIZED (SELECT u, v FROM {edges} UNION SELECT v, u FROM {edges}),
{out}_reach(v, r) USING KEY (v) AS (SELECT DISTINCT u, u FROM {out}_both
  UNION SELECT b.v, max(x.r) FROM {out}_reach x JOIN {out}_both b ON b.u = x.v JOIN recurring.{out}_reach y ON y.v = b.v WHERE x.r > y.r GROUP BY b.v),
{out} AS (SELECT read_id, coalesce(r, read_id) AS comp_id FROM reads LEFT JOIN {out}_reach ON v = read_id)"""


#: Holds while no cluster of components that mates join has more reads than the cap.
_MERGED = f"""mated AS (SELECT u, v FROM edges UNION SELECT greatest(read_id, mate_id), least(read_id, mate_id) FROM reads WHERE mate_id IS NOT NULL),
{_components("mated", "merged")}"""
_SIZES = "sizes AS (SELECT comp_id, count(*) AS n FROM {} GROUP BY comp_id)"
_PARTED = f"""{_SIZES.format("merged")},
parted AS (SELECT comp_id, n, CAST(CASE WHEN total < {PARTS} THEN {PARTS - 1} ELSE least({PARTS - 1}, before // (total // {PARTS})) END AS INTEGER) AS part_id
  FROM (SELECT comp_id, n, CAST(coalesce(sum(n) OVER (ORDER BY comp_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(n) OVER () AS BIGINT) AS total FROM sizes))"""
_MANIFEST = """manifest AS (SELECT part_id, read_id FROM (
  SELECT r.read_id, unnest(list_distinct([m.comp_id, coalesce(o.comp_id, m.comp_id)])) AS comp_id FROM reads r JOIN merged m ON m.read_id = r.read_id LEFT JOIN merged o ON o.read_id = r.mate_id) JOIN parted USING (comp_id))"""


def _with(*parts: str) -> str:
    *tables, select = parts
    return "WITH RECURSIVE " + ",\n".join(tables) + "\n" + select


_LINKED = (_OCC, _groups(), _edges())
_HISTOGRAM = f"histogram AS (SELECT {_bucket('kmer')} AS bucket, count(*) AS n FROM occ GROUP BY 1)"
_PREFIX = f"""prefix AS (SELECT bucket, CAST(coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM (SELECT * FROM histogram UNION ALL SELECT {4**10}, 0))"""
#: Scans the buckets: a row per boundary, the first bucket beyond the last boundary whose prefix sum is large enough.
_RANGES = f"""average AS (SELECT (max(before) + {PARTS - 1}) // {PARTS} AS avg FROM prefix),
steps AS (SELECT bucket + 1 AS low, lead(bucket) OVER (ORDER BY bucket) AS high, lead(before) OVER (ORDER BY bucket) AS reached FROM prefix),
ranges AS (SELECT 0 AS idx, 0 AS bound UNION ALL
  SELECT r.idx + 1, CAST(coalesce((SELECT min(greatest(low, CASE WHEN r.idx = 0 THEN 0 ELSE r.bound + 1 END)) FROM steps, average
    WHERE reached >= (r.idx + 1) * avg AND high >= CASE WHEN r.idx = 0 THEN 0 ELSE r.bound + 1 END), {4**10}) AS INTEGER) FROM ranges r WHERE r.idx < {PARTS})"""

#: Pairs and single reads in their order, with the names that files give them.
_NAMED = """named AS (SELECT seq, pair, CASE WHEN pair AND mate_id < read_id THEN 1 ELSE 0 END AS side, dense_rank() OVER (PARTITION BY pair ORDER BY first) - 1 AS rank,
    '@r' || first || CASE WHEN NOT pair THEN '' WHEN mate_id < read_id THEN '/2' ELSE '/1' END AS header
  FROM (SELECT *, mate_id IS NOT NULL AS pair, least(read_id, coalesce(mate_id, read_id)) AS first FROM reads))"""

ORACLE_SQL: dict[str, str] = {
    "read_inventory": _with(_F1, "SELECT read_id, doc_id, length(seq) AS bases, length(seq) - length(replace(seq, 'N', '')) AS ambiguous FROM reads"),
    "paired_read_inventory": _with(_F2, "SELECT read_id, coalesce(mate_id, -1) AS mate_id, doc_id, seq FROM reads"),
    "conversation_read_inventory": _with(_F3, "SELECT read_id, coalesce(mate_id, -1) AS mate_id, seq FROM reads"),
    "read_totals": _with(_F1, _OCC, "SELECT (SELECT count(*) FROM reads) AS reads, (SELECT CAST(sum(length(seq)) AS BIGINT) FROM reads) AS bases, (SELECT count(*) FROM occ) AS kmers"),
    "kmer_occurrences": _with(_F1, _OCC, "SELECT read_id, count(*) AS n, min(kmer) AS least, max(kmer) AS greatest FROM occ GROUP BY read_id"),
    "kmer_canonical_counts": _with(_F1, _OCC, "SELECT kmer, count(*) AS n, count(DISTINCT read_id) AS reads FROM occ GROUP BY kmer"),
    "kmer_neighbours": _with(_F1, _OCC, 'SELECT pv AS prev, nx AS "next", count(*) AS n FROM occ GROUP BY pv, nx'),
    "bucket_histogram": _with(_F1, _OCC, _HISTOGRAM, "SELECT * FROM histogram"),
    "chunk_bucket_histogram": _with(_F1, _OCC, f"SELECT CAST(read_id // {CHUNK} AS INTEGER) AS chunk_id, {_bucket('kmer')} AS bucket, count(*) AS n FROM occ GROUP BY 1, 2"),
    "bucket_prefix_sum": _with(_F1, _OCC, _HISTOGRAM, _PREFIX, "SELECT * FROM prefix"),
    "equal_frequency_ranges": _with(_F1, _OCC, _HISTOGRAM, _PREFIX, _RANGES, "SELECT idx, bound FROM ranges"),
    "reads_per_chunk": _with(_F1, f"SELECT CAST(read_id // {CHUNK} AS INTEGER) AS chunk_id, count(*) AS n, min(read_id) AS first_read_id FROM reads GROUP BY 1"),
    "kmer_degree": _with(_F1, _OCC, "SELECT kmer, count(DISTINCT read_id) AS deg FROM occ GROUP BY kmer"),
    "degree_distribution": _with(_F1, _OCC, "SELECT deg, count(*) AS kmers FROM (SELECT kmer, count(DISTINCT read_id) AS deg FROM occ GROUP BY kmer) GROUP BY deg"),
    "branch_groups": _with(_F1, _OCC, _groups(), "SELECT * FROM groups"),
    "ambiguous_kmers": _with(_F1, _OCC, _groups(), "SELECT kmer FROM groups WHERE n_prev > 1 AND n_next > 1"),
    "bad_reads": _with(_F1, *_LINKED, "SELECT read_id FROM bad"),
    "mischief_count": _with(_F1, _OCC, _groups(), "SELECT count(*) AS mischief FROM groups WHERE n_prev > 1 AND n_next > 1 AND 5 * s_prev >= 2 * deg AND 5 * s_next >= 2 * deg"),
    "star_edges": _with(_F1, *_LINKED, "SELECT u, v FROM edges"),
    "star_edges_by_degree": _with(_F1, _OCC, _groups(), _edges(degree="deg >= 3 AND deg < 10"), "SELECT u, v FROM edges"),
    "read_components": _with(_F1, *_LINKED, _components(), "SELECT read_id, comp_id FROM comps"),
    "component_sizes": _with(_F1, *_LINKED, _components(), _SIZES.format("comps"), "SELECT * FROM sizes"),
    "largest_component": _with(_F1, *_LINKED, _components(), """SELECT comp_id, n FROM (
  SELECT comp_id, count(*) AS n, max(read_id) FILTER (read_id <> comp_id) AS second FROM comps GROUP BY comp_id) WHERE n > 1 ORDER BY n DESC, second LIMIT 1"""),
    "component_size_distribution": _with(_F1, *_LINKED, _components(), _SIZES.format("comps"), "SELECT n, count(*) AS components FROM sizes GROUP BY n"),
    "separated_pairs": _with(_F2, *_LINKED, _components(), """SELECT count(*) AS separated FROM reads r JOIN comps a ON a.read_id = r.read_id JOIN comps b ON b.read_id = r.mate_id
WHERE r.read_id < r.mate_id AND a.comp_id <> b.comp_id AND NOT (a.comp_id = r.read_id AND b.comp_id = r.mate_id)"""),
    "mate_merged_components": _with(_F2, *_LINKED, _MERGED, "SELECT read_id, comp_id FROM merged"),
    "conversation_components": _with(_F3, *_LINKED, _MERGED, "SELECT read_id, comp_id FROM merged"),
    "supported_component_merge": _with(_F2, *_LINKED, _components(), """strong AS (SELECT greatest(a.comp_id, b.comp_id) AS u, least(a.comp_id, b.comp_id) AS v FROM reads r
    JOIN comps a ON a.read_id = r.read_id JOIN comps b ON b.read_id = r.mate_id WHERE r.read_id < r.mate_id AND a.comp_id <> b.comp_id GROUP BY ALL HAVING count(*) > 1
  UNION SELECT u, v FROM edges)""", _components("strong", "joined"), "SELECT read_id, comp_id FROM joined"),
    "component_partitions_16": _with(_F2, *_LINKED, _MERGED, _PARTED, "SELECT * FROM parted"),
    "partition_manifest_16": _with(_F2, *_LINKED, _MERGED, _PARTED, _MANIFEST, "SELECT * FROM manifest"),
    "partition_sizes": _with(_F2, *_LINKED, _MERGED, _PARTED, _MANIFEST, "SELECT part_id, count(*) AS n FROM manifest GROUP BY part_id"),
    "minimizers3": _with(_F1, _OCC, _MIN3, 'SELECT read_id, kmer, pv AS prev, nx AS "next" FROM mins'),
    "minimizer_histogram": _with(_F1, _OCC, _MIN3, f"SELECT {_bucket('kmer')} AS bucket, count(*) AS n FROM mins GROUP BY 1"),
    "minimizer_components": _with(_F1, _OCC, _MIN3, _groups("mins"), _edges("mins"), _components(), "SELECT read_id, comp_id FROM comps"),
    "fastq_round_trip": _with(_F1, "SELECT '@r' || read_id AS header, seq, length(seq) AS quals FROM reads"),
    "paired_input_set": _with(_F2, _NAMED, """SELECT 2 * rank + side AS read_id, CASE WHEN pair THEN 2 * rank + 1 - side ELSE -1 END AS mate_id, header, seq FROM named WHERE pair
  UNION ALL SELECT rank + (SELECT count(*) FROM reads WHERE mate_id IS NOT NULL), -1, header, seq FROM named WHERE NOT pair"""),
    "interleaved_input_set": _with(_F2, _NAMED, """SELECT rank AS read_id, CAST(-1 AS BIGINT) AS mate_id, header, seq FROM named WHERE NOT pair
  UNION ALL SELECT 2 * rank + side + n, 2 * rank + 1 - side + n, header, seq FROM named, (SELECT count(*) AS n FROM reads WHERE mate_id IS NULL) WHERE pair"""),
    "stored_chunk_index": _with(_F1, f"""placed AS (SELECT read_id // {FILE_IDS} AS file, size, CAST(sum(size) OVER (PARTITION BY read_id // {FILE_IDS} ORDER BY read_id) AS BIGINT) - size AS pos
    FROM (SELECT read_id, length(read_id || '') + 2 * length(seq) + 7 AS size FROM reads)),
  files AS (SELECT file, CAST(row_number() OVER (ORDER BY file) - 1 AS INTEGER) AS file_no, CAST(coalesce(sum(ranges) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS base
    FROM (SELECT file, (sum(size) + {RANGE - 1}) // {RANGE} AS ranges FROM placed GROUP BY file))""",
  f"SELECT CAST(base + pos // {RANGE} AS INTEGER) AS chunk_id, file_no, min(pos) AS first_offset, count(*) AS n FROM placed JOIN files USING (file) GROUP BY ALL"),
    "indexed_input_set": _with(_F1, "SELECT read_id, CAST(-1 AS BIGINT) AS mate_id, '@r' || read_id AS header, seq FROM reads"),
    "written_partitions": _with(_F2, *_LINKED, _MERGED, _PARTED, _MANIFEST, "SELECT part_id, '@r' || read_id AS header, seq FROM manifest JOIN reads USING (read_id)"),
    "written_largest_component": _with(_F1, *_LINKED, _components(), """SELECT comp_id = (SELECT comp_id FROM (
  SELECT comp_id, count(*) AS n, max(read_id) FILTER (read_id <> comp_id) AS second FROM comps GROUP BY comp_id) WHERE n > 1 ORDER BY n DESC, second LIMIT 1) AS largest, '@r' || read_id AS header, seq
FROM comps JOIN reads USING (read_id)"""),
    "component_dump": _with(_F1, *_LINKED, _components(), _SIZES.format("comps"), "SELECT comp_id, read_id, n FROM comps JOIN sizes USING (comp_id) WHERE n > 1"),
}
