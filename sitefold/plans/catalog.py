"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.checkpoints import shared_folder
from sitefold.functions import diversity, scoring, vectors
from sitefold.functions.ids import generate_posid
from sitefold.operators import abundance, components, islands, legacy, multihits, scan, standardize, track
from sitefold.operators.unique import unique_granges
from sitefold.plans import oracles as Q
from sitefold.plans import samples as P
from sitefold.schema import five_prime
from sitefold.sources import dbrows, fastq, generate

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

ROW = 'seqnames, "start", "end", strand, sample, replicate, counts'
S = P.SITES


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _points(spark: SparkSession, d: str) -> DataFrame:
    return standardize.points(P.sites(spark, d), five_prime(), None, 5)


# positions, rows and sets

query("posid", f"WITH {S} SELECT {ROW}, posid FROM sites")(lambda s, d: generate_posid(P.sites(s, d)))
query(
    "db_import",
    f"""WITH {S}, db AS (SELECT *, 'SMP' || sample || '-' || CAST(replicate AS VARCHAR) AS samplename FROM sites)
SELECT seqnames, "start", "end", strand, samplename, split_part(samplename, '-', 1) AS specimen, counts > 25 AS ismulti FROM db""",
)(lambda s, d: dbrows.db_to_sites(P.database_rows(s, d)))
query("vcollapse", "SELECT n_nationkey, replace(CAST(n_nationkey AS VARCHAR), ' ', '') || '-' || replace(n_name, ' ', '') || '-' || CAST(n_regionkey AS VARCHAR) AS v FROM nation")(
    lambda s, d: (lambda n: n.select("n_nationkey", vectors.vcollapse(n, "n_nationkey", "n_name", "n_regionkey", sep="-").alias("v")))(P.load(s, d, "nation"))
)
query(
    "vzip",
    "SELECT n_nationkey, CAST(i AS BIGINT) AS i, CAST(CASE i WHEN 0 THEN n_nationkey WHEN 1 THEN n_regionkey WHEN 2 THEN n_nationkey * 2 ELSE n_regionkey + 7 END AS BIGINT) AS value FROM nation, range(4) t(i)",
)(
    lambda s, d: P.load(s, d, "nation")
    .select(F.col("n_nationkey").cast("bigint").alias("a"), F.col("n_regionkey").cast("bigint").alias("b"), "n_nationkey")
    .select("n_nationkey", F.posexplode(vectors.vzip(F.array("a", F.col("a") * 2), F.array("b", F.col("b") + 7))).alias("i", "value"))
    .withColumn("i", F.col("i").cast("bigint"))
)
query(
    "vintersect",
    "WITH a AS (SELECT CAST(c_nationkey AS VARCHAR) AS v FROM customer GROUP BY 1 UNION ALL SELECT CAST(s_nationkey AS VARCHAR) FROM supplier GROUP BY 1 "
    "UNION ALL SELECT CAST(n_regionkey AS VARCHAR) FROM nation GROUP BY 1) SELECT v AS value FROM a GROUP BY v HAVING count(*) >= 3",
)(
    lambda s, d: vectors.vintersect(
        P.load(s, d, "customer").select("c_nationkey").distinct(), P.load(s, d, "supplier").select("s_nationkey").distinct(), P.load(s, d, "nation").select("n_regionkey").distinct(), limit=3
    )
)
query(
    "scan_format",
    f"""WITH {S}, x AS (SELECT DISTINCT seqnames AS chr, five AS pos, replicate, CASE WHEN sample = 'A' THEN 0 ELSE 1 END AS grp FROM sites)
SELECT chr, pos, grp FROM x""",
)(lambda s, d: scan.scan_format(P.sites(s, d).filter("sample = 'A'"), P.sites(s, d).filter("sample <> 'A'"), "replicate"))
query("quick_format", f"WITH {S} SELECT DISTINCT seqnames AS chr, five AS pos FROM sites")(lambda s, d: scan.scan_points(P.sites(s, d)))


def _scan_points(spark: SparkSession, d: str) -> DataFrame:
    return P.load(spark, d, "events").select(
        F.col("event_type").alias("chr"), F.col("event_id").alias("pos"), (F.col("user_id") % 100 < 30 + 30 * (F.floor(F.col("event_id") / 300) % 2)).cast("int").alias("grp")
    )


def _marks(k: int) -> str:
    """Windows of k points with the chance of a count as small, and as large, from the terms of the binomial distribution."""
    w = f"PARTITION BY chr ORDER BY pos, grp ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING"
    binom = ", ".join(f"({i}, {math.comb(k, i)}.0)" for i in range(k + 1))
    return f"""b{k} AS (SELECT i, CAST(c AS DOUBLE) * pow(share, i) * pow(1 - share, {k} - i) AS p FROM (VALUES {binom}) v(i, c), s),
t{k} AS (SELECT i, sum(p) OVER (ORDER BY i) AS lo, sum(p) OVER (ORDER BY i DESC) AS hi FROM b{k}),
m{k} AS (SELECT chr, pos AS start, max(pos) OVER ({w}) AS "end", sum(grp) OVER ({w}) AS n, count(*) OVER ({w}) AS k FROM pt),
d{k} AS (SELECT chr, start, "end", CASE WHEN hi <= 0.005 THEN 1 WHEN lo <= 0.005 THEN -1 END AS direction FROM m{k} JOIN t{k} ON i = n WHERE k = {k} AND (hi <= 0.005 OR lo <= 0.005))"""


query(
    "scan_clusters",
    f"""WITH pt AS (SELECT event_type AS chr, event_id AS pos, CAST(user_id % 100 < 30 + 30 * ((event_id // 300) % 2) AS INT) AS grp FROM events),
s AS (SELECT avg(grp) AS share FROM pt), {_marks(10)}, {_marks(20)}, u AS (SELECT * FROM d10 UNION ALL SELECT * FROM d20),
n AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chr, direction ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM u),
c AS (SELECT *, sum(nw) OVER (PARTITION BY chr, direction ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS c FROM n)
SELECT chr, min(start) AS start, max("end") AS "end", direction, count(*) AS windows FROM c GROUP BY chr, direction, c""",
)(lambda s, d: scan.scan_clusters(_scan_points(s, d), (10, 20), 0.01))
query(
    "unique_sum",
    f'WITH {S} SELECT seqnames, "start", "end", strand, sample, CAST(sum(counts) AS BIGINT) AS counts FROM sites GROUP BY seqnames, "start", "end", strand, sample',
)(lambda s, d: unique_granges(P.sites(s, d), sum_cols=True, rm_cols=["replicate"]))
query("unique_distinct", f'WITH {S} SELECT DISTINCT seqnames, "start", "end", strand, sample, replicate FROM sites')(
    lambda s, d: unique_granges(P.sites(s, d), rm_cols=["counts"])
)
query("unique_twins", f'WITH {S} SELECT DISTINCT {ROW} FROM sites')(
    lambda s, d: unique_granges(P.sites(s, d).withColumn("counts_2", F.col("counts")), rm_dup_cols=r"^[a-z]+")
)
for _g in (0, 1, 2, 5):
    query(f"serial_cluster_g{_g}", f'WITH {S}, {Q.chained(_g)} SELECT {", ".join("s." + c.strip() for c in ROW.split(","))}, c.number AS clusID_{_g}nt FROM sites s JOIN chain c ON s.seqnames = c.seqnames AND s.strand = c.strand AND s.five = c.pos')(
        lambda s, d, g=_g: islands.serial_cluster(P.sites(s, d), (g,))
    )
query(
    "graph_clusters",
    f"""WITH {S}, {Q.chained(5)}, r AS (SELECT *, {"concat_ws(':', seqnames, strand, five, width, sample, replicate)"} AS id FROM sites),
n AS (SELECT DISTINCT r.id, c.number, c.pos FROM r JOIN chain c ON r.seqnames = c.seqnames AND r.strand = c.strand AND r.five = c.pos)
SELECT first_value(id) OVER (PARTITION BY number ORDER BY pos, id) AS src, id AS dst FROM n""",
)(
    lambda s, d: islands.graph_clusters(
        P.sites(s, d).withColumn("row_id", F.concat_ws(":", "seqnames", "strand", five_prime().cast("string"), (F.col("end") - F.col("start") + 1).cast("string"), "sample", F.col("replicate").cast("string"))), 5
    )
)


# abundance

_ab = """ab AS (SELECT posid, {g} AS "group", count(DISTINCT (width, {r})) AS estAbund FROM sites GROUP BY ALL),
rk AS (SELECT posid, "group", estAbund, CAST(estAbund AS DOUBLE) / CAST(sum(estAbund) OVER (PARTITION BY "group") AS BIGINT) AS relAbund,
  count(*) OVER (PARTITION BY "group" ORDER BY estAbund DESC RANGE UNBOUNDED PRECEDING) AS relRank FROM ab)"""
AB, AB_G = _ab.format(g="'group1'", r="1"), _ab.format(g="sample", r="replicate")
query("abundance", f"WITH {S}, {AB} SELECT * FROM rk")(lambda s, d: abundance.determine_abundance(P.sites(s, d)))
query("abundance_grouped", f"WITH {S}, {AB_G} SELECT * FROM rk")(lambda s, d: abundance.determine_abundance(P.sites(s, d), "sample", "replicate"))
ORDER = ("start", "end", "sample", "replicate", "counts")
_first = """f AS (SELECT *, row_number() OVER (PARTITION BY posid, {g} ORDER BY "start", "end", sample, replicate, counts) AS rn FROM sites)"""
query("condense", f"""WITH {S}, {_first.format(g="sample")} SELECT seqnames, five AS "start", five AS "end", strand, sample, replicate, counts, posid FROM f WHERE rn = 1""")(
    lambda s, d: abundance.condense_intsites(P.sites(s, d), "sample", order_by=ORDER)
)
query(
    "condense_abundance",
    f"""WITH {S}, {_first.format(g="sample")}, {AB_G}
SELECT seqnames, five AS "start", five AS "end", strand, sample, replicate, counts, estAbund, relAbund, relRank, f.posid FROM f JOIN rk ON f.posid = rk.posid AND f.sample = rk."group" WHERE rn = 1""",
)(lambda s, d: abundance.condense_intsites(P.sites(s, d), "sample", True, replicates="replicate", order_by=ORDER))


def _em(rounds: int) -> str:
    """The rounds of the estimate, one after another, from each group's seen pairs."""
    steps = ["e0 AS MATERIALIZED (SELECT posid, g, cell, CAST(count(*) OVER (PARTITION BY g, posid) AS DOUBLE) AS th, count(*) OVER (PARTITION BY g, cell) / count(*) OVER (PARTITION BY g) AS ph FROM pr)"]
    for i in range(rounds):
        steps.append(f"x{i} AS MATERIALIZED (SELECT posid, g, cell, th * ph / (1 - exp(-th * ph)) AS x FROM e{i})")
        steps.append(
            f"e{i + 1} AS MATERIALIZED (SELECT posid, g, cell, sum(x) OVER (PARTITION BY g, posid) AS th, sum(x) OVER (PARTITION BY g, cell) / sum(x) OVER (PARTITION BY g) AS ph FROM x{i})"
        )
    return ", ".join(steps)


EM_ROUNDS = 8
query(
    "est_abund",
    f"""WITH {S}, pr AS (SELECT DISTINCT posid, sample AS g, CAST(width AS VARCHAR) || '|' || CAST(replicate AS VARCHAR) AS cell FROM sites), {_em(EM_ROUNDS)}
SELECT posid, g AS "group", round(max(th), 4) AS estAbund FROM e{EM_ROUNDS} GROUP BY posid, g""",
)(
    lambda s, d: abundance.determine_abundance(P.sites(s, d), "sample", "replicate", method="estAbund", rounds=EM_ROUNDS, tolerance=0).select(
        "posid", "group", F.round("estAbund", 4).alias("estAbund")
    )
)


# consensus positions and their phases

query("refine_breakpoints", Q.refined())(lambda s, d: standardize.refine_breakpoints(P.sites(s, d)))
query("refine_breakpoints_counts", Q.refined("counts"))(lambda s, d: standardize.refine_breakpoints(P.sites(s, d), "counts"))
query("standardize_sites", Q.standardized())(lambda s, d: standardize.standardize_sites(P.sites(s, d)))
query("standardize_sites_counts", Q.standardized("counts"))(lambda s, d: standardize.standardize_sites(P.sites(s, d), "counts"))
query("standardize_sites_details", Q.standardized(details=True))(lambda s, d: standardize.standardize_sites(P.sites(s, d), details=True))
query("standardize_sites_gap0", Q.standardized(min_gap=0, sata_gap=3))(lambda s, d: standardize.standardize_sites(P.sites(s, d), min_gap=0, sata_gap=3))
_pts = f"WITH {S}, {Q.points('five', '1')}, {Q.initial(1, 'upstream')}"
query("initial_links", f"{_pts} SELECT seqnames, strand, pos, abund, link FROM l1")(
    lambda s, d: standardize.initial_links(_points(s, d), 1, "upstream").select("seqnames", "strand", "pos", "abund", "link")
)
query("satellite_g2", f"{_pts}, {Q.satellite('l1', 2)} SELECT seqnames, strand, pos, abund, link FROM l2")(
    lambda s, d: standardize.connect_satellites(standardize.initial_links(_points(s, d), 1, "upstream"), 2).select("seqnames", "strand", "pos", "abund", "link")
)
query("break_paths", f"WITH {S}, {Q.linked('five', '1', 1, 5, 'upstream')} SELECT seqnames, strand, pos, abund, link FROM marked")(
    lambda s, d: standardize.linked(_points(s, d), 1, 5, "upstream").select("seqnames", "strand", "pos", "abund", "link")
)
query("sources_sinks", f"WITH {S}, {Q.linked('five', '1', 1, 5, 'upstream')} SELECT seqnames, strand, pos, is_source, is_sink FROM marked")(
    lambda s, d: standardize.linked(_points(s, d), 1, 5, "upstream").select("seqnames", "strand", "pos", "is_source", "is_sink")
)
query("connect_sources", f"""WITH {S}, {Q.linked("five", "1", 1, 5, "upstream")}, {Q.grouped(5)} SELECT seqnames, strand, pos, min(pos) OVER (PARTITION BY seqnames, strand, "group") AS first_of_group FROM grp""")(
    lambda s, d: standardize.connect_sources(standardize.linked(_points(s, d), 1, 5, "upstream"), 5)
    .withColumn("first_of_group", F.expr("min(pos) over (partition by seqnames, strand, chain, `group`)"))
    .select("seqnames", "strand", "pos", "first_of_group")
)
query("resolve_sources", f"WITH {S}, {Q.linked('five', '1', 1, 5, 'upstream')}, {Q.grouped(5)}, {Q.RESOLVED} SELECT * FROM called")(
    lambda s, d: standardize.called_sites(P.sites(s, d))
)
query(
    "modal_normalize",
    f"""WITH {S}, {Q.chained(2)}, c AS (SELECT s.*, k.number, k.island FROM sites s JOIN chain k ON s.seqnames = k.seqnames AND s.strand = k.strand AND s.five = k.pos),
n AS (SELECT number, five, strand, count(*) AS k FROM c GROUP BY ALL),
b AS (SELECT number, five AS norm, row_number() OVER (PARTITION BY number ORDER BY k DESC, CASE WHEN strand = '-' THEN -five ELSE five END) AS rn FROM n)
SELECT seqnames, CASE WHEN strand = '-' THEN three ELSE norm END AS "start", CASE WHEN strand = '-' THEN norm ELSE three END AS "end", strand, sample, replicate, counts,
  five AS called_pos, three AS called_bp, island AS pos_clus, norm AS norm_pos FROM c JOIN b ON c.number = b.number AND rn = 1""",
)(lambda s, d: legacy.normalize_intsite_positions(P.sites(s, d), 2))


# windows of the older method

_counts = f"""WITH {S}, n AS (SELECT sample AS grouping, seqnames || strand AS posID, five AS value, CAST(sum(counts) AS BIGINT) AS freq FROM sites GROUP BY ALL)"""


def _snap(source: str, out: str) -> str:
    return f"""{out}_p AS (SELECT a.grouping, a.posID, a.value, a.freq, greatest(a.freq, b.freq) AS m,
  CASE WHEN a.freq = b.freq THEN least(a.value, b.value) WHEN a.freq > b.freq THEN a.value ELSE b.value END AS w
  FROM {source} a JOIN {source} b ON a.grouping = b.grouping AND a.posID = b.posID AND a.value <> b.value AND abs(a.value - b.value) <= 5),
{out}_b AS (SELECT grouping, posID, value, w, row_number() OVER (PARTITION BY grouping, posID, value ORDER BY m DESC, w) AS rn FROM {out}_p),
{out} AS (SELECT a.grouping, a.posID, a.value, a.freq, coalesce(b.w, a.value) AS cv FROM {source} a LEFT JOIN {out}_b b ON rn = 1 AND a.grouping = b.grouping AND a.posID = b.posID AND a.value = b.value)"""


_end = 'SELECT grouping, posID, value, freq, cv AS clusteredValue, CAST(sum(freq) OVER (PARTITION BY grouping, posID, cv) AS BIGINT) AS "clusteredValue.freq" FROM r'


def _legacy(spark: SparkSession, d: str, **options) -> DataFrame:
    rows = P.sites(spark, d).withColumns({"pid": F.concat("seqnames", "strand"), "at": five_prime()})
    return legacy.cluster_values(rows, "pid", "at", "sample", "counts", **options)


query("legacy_cluster_sites", f"{_counts}, {_snap('n', 'r')} {_end}")(_legacy)
query(
    "legacy_cluster_sites_quartile",
    f"""{_counts}, q AS (SELECT *, quantile_cont(freq, 0.7) OVER (PARTITION BY grouping, posID) AS lim FROM n),
lo AS (SELECT * FROM q WHERE freq < lim), hi AS (SELECT * FROM q WHERE freq >= lim),
t AS (SELECT a.grouping, a.posID, a.value, a.freq, b.value AS cv, row_number() OVER (PARTITION BY a.grouping, a.posID, a.value ORDER BY b.freq DESC, abs(a.value - b.value), b.value DESC) AS rn
  FROM lo a JOIN hi b ON a.grouping = b.grouping AND a.posID = b.posID AND abs(a.value - b.value) <= 5),
lone AS (SELECT grouping, posID, value, freq FROM lo WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.grouping = lo.grouping AND t.posID = lo.posID AND t.value = lo.value)),
{_snap("lone", "z")},
r AS (SELECT grouping, posID, value, freq, value AS cv FROM hi UNION ALL SELECT grouping, posID, value, freq, cv FROM t WHERE rn = 1 UNION ALL SELECT * FROM z) {_end}""",
)(lambda s, d: _legacy(s, d, by_quartile=True))
query(
    "legacy_standardize",
    f"""WITH {S}, n AS (SELECT '' AS grouping, seqnames || strand AS posID, five AS value, count(*) AS freq FROM sites GROUP BY ALL), {_snap("n", "r")}
SELECT seqnames, CASE WHEN strand = '+' THEN cv ELSE "start" END AS "start", CASE WHEN strand = '+' THEN "end" ELSE cv END AS "end", strand, sample, replicate, counts
FROM sites JOIN r ON r.posID = seqnames || strand AND r.value = five""",
)(lambda s, d: legacy.standardize_by_window(P.sites(s, d)))


def _table_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = P.sites(spark, d).withColumns({"Position": five_prime(), "isMultiHit": F.col("counts") == 50, "score": F.col("end") - F.col("start")})
    return legacy.cluster_sites(rows, weight="counts", grouping="sample", score="score")


query(
    "legacy_cluster_table",
    f"""WITH {S}, m AS (SELECT *, seqnames || '|' || strand AS pk, counts = 50 AS multi, "end" - "start" AS score FROM sites),
n AS (SELECT sample AS grouping, pk AS posID, five AS value, CAST(sum(counts) AS BIGINT) AS freq FROM m WHERE NOT multi GROUP BY ALL), {_snap("n", "r")},
k AS (SELECT *, CAST(sum(freq) OVER (PARTITION BY grouping, posID, cv) AS BIGINT) AS total FROM r),
j AS (SELECT m.*, cv, total, max(score) OVER (PARTITION BY m.sample, m.pk, cv) AS best FROM m LEFT JOIN k ON NOT multi AND k.grouping = m.sample AND k.posID = m.pk AND k.value = m.five)
SELECT {ROW}, five AS "Position", multi AS "isMultiHit", score, cv AS "clusteredPosition", total AS clonecount, coalesce(cv IS NOT NULL AND score = best, false) AS "clusterTopHit" FROM j""",
)(_table_mode)


# clones in several sets

def _tracked(gap: int) -> str:
    return f"""WITH {S}, p AS (SELECT DISTINCT seqnames, strand, five, sample FROM sites)
SELECT DISTINCT seqnames, "start", "end", strand, sample, replicate, counts, posid FROM sites s
WHERE EXISTS (SELECT 1 FROM p WHERE p.seqnames = s.seqnames AND p.strand = s.strand AND p.five BETWEEN s.five - {gap} AND s.five + {gap} AND p.sample <> s.sample)"""


query("track_clones", _tracked(5))(lambda s, d: track.track_clones(P.sites(s, d), 5, origin="sample"))
query("track_clones_g0", _tracked(0))(lambda s, d: track.track_clones(P.sites(s, d), 0, origin="sample"))



def _tables(spark: SparkSession, d: str) -> DataFrame:
    """A table for each sample, with different metadata; the sets are known by their place in the list."""
    all_ = P.sites(spark, d)
    a, n, r = (all_.filter(F.col("sample") == x).drop("sample") for x in "ANR")
    return track.track_clones([a.drop("replicate"), n.withColumn("note", F.lit("n")), r], 3)


query(
    "track_clones_tables",
    f"""WITH {S}, o AS (SELECT *, CASE sample WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END AS origin FROM sites), p AS (SELECT DISTINCT seqnames, strand, five, origin FROM o)
SELECT DISTINCT seqnames, "start", "end", strand, CASE WHEN origin <> '1' THEN replicate END AS replicate, counts, CASE WHEN origin = '2' THEN 'n' END AS note, origin, posid FROM o s
WHERE EXISTS (SELECT 1 FROM p WHERE p.seqnames = s.seqnames AND p.strand = s.strand AND p.five BETWEEN s.five - 3 AND s.five + 3 AND p.origin <> s.origin)""",
)(_tables)


# components

_kv = P.PAIRS


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """From each part to its suppliers, as nodes of one kind."""
    return P.load(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))


_num = "num AS (SELECT label, dense_rank() OVER (ORDER BY label) AS clus FROM label GROUP BY label)"
query("cluster_kv", f"WITH RECURSIVE {_kv}, {Q.components('pr')}, {_num} SELECT k AS key, v AS val, clus FROM pr JOIN label ON k = node JOIN num USING (label)")(
    lambda s, d: components.cluster_kv(P.pairs(s, d))
)
query("cluster_kv_simple", f"WITH RECURSIVE {_kv}, {Q.components('pr')}, {_num} SELECT node AS key, clus FROM label JOIN num USING (label)")(
    lambda s, d: components.cluster_kv(P.pairs(s, d), returns="simple")
)
query(
    "cluster_kv_graph",
    f"WITH {_kv}, h AS (SELECT v, min(k) AS hub FROM pr GROUP BY v) SELECT DISTINCT greatest(k, hub) AS u, least(k, hub) AS v FROM pr JOIN h USING (v) WHERE k <> hub",
)(lambda s, d: components.cluster_kv(P.pairs(s, d), returns="graph"))
query(
    "bidirectional_edges",
    "WITH e AS (SELECT DISTINCT l_partkey AS u, l_suppkey AS v FROM lineitem WHERE l_partkey <> l_suppkey) "
    "SELECT CAST(least(u, v) AS VARCHAR) || ':' || CAST(greatest(u, v) AS VARCHAR) AS edge_id FROM e GROUP BY 1 HAVING count(*) > 1",
)(lambda s, d: components.bidirectional(_edges(s, d)))
query(
    "source_deficiency",
    "WITH e AS (SELECT DISTINCT l_partkey AS u, l_suppkey AS v FROM lineitem) "
    "SELECT u, v FROM e QUALIFY row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY u, v) = 1",
)(lambda s, d: components.one_direction(_edges(s, d).distinct(), F.col("u")))
_mh = f"""WITH RECURSIVE {P.MULTIHITS}, {Q.chained(5, "five", "multihits")},
pr AS (SELECT DISTINCT m.readPairKey AS k, c.number AS v FROM multihits m JOIN chain c ON m.seqnames = c.seqnames AND m.strand = c.strand AND m.five = c.pos),
{Q.components("pr")}, num AS (SELECT label, dense_rank() OVER (ORDER BY label) AS multihitID FROM label GROUP BY label),
cl AS (SELECT m.* EXCLUDE (multihitid), num.multihitID AS clusterno FROM multihits m JOIN label ON node = readPairKey JOIN num USING (label))"""
MH_ROW = 'seqnames, "start", "end", strand, sample'
query("cluster_multihits", f"{_mh} SELECT {MH_ROW}, readPairKey, ID, clusterno FROM cl")(
    lambda s, d: multihits.cluster_multihits(P.multihits(s, d).drop("multihitid"))["unclusteredMultihits"].withColumnRenamed("multihitID", "clusterno")
)
query("cluster_multihits_positions", f'{_mh} SELECT DISTINCT clusterno AS multihitID, seqnames, five AS "start", five AS "end", strand FROM cl')(
    lambda s, d: multihits.cluster_multihits(P.multihits(s, d).drop("multihitid"))["clusteredMultihitPositions"]
)
query(
    "cluster_multihits_lengths",
    f"""{_mh}, md AS (SELECT ID, CAST(round_even(quantile_cont(width, 0.5), 0) AS BIGINT) AS length FROM multihits GROUP BY ID),
rd AS (SELECT DISTINCT clusterno, ID FROM cl) SELECT clusterno AS multihitID, length, count(*) AS count FROM rd JOIN md USING (ID) GROUP BY ALL""",
)(lambda s, d: multihits.cluster_multihits(P.multihits(s, d).drop("multihitid"))["clusteredMultihitLengths"])
query(
    "normalize_multihit",
    f"""WITH RECURSIVE {P.MULTIHITS}, pr AS (SELECT DISTINCT sample AS g, multihitid AS k, posid AS v FROM multihits), {Q.components("pr", "g")},
gn AS (SELECT g, dense_rank() OVER (ORDER BY g) AS n FROM pr GROUP BY g), cn AS (SELECT g, label, dense_rank() OVER (PARTITION BY g ORDER BY label) AS c FROM label GROUP BY g, label)
SELECT {MH_ROW}, readPairKey, ID, multihitid, CAST(n AS VARCHAR) || ':' || CAST(c AS VARCHAR) AS "norm.multihitid"
FROM multihits JOIN label l ON l.g = sample AND node = multihitid JOIN gn ON gn.g = sample JOIN cn ON cn.g = sample AND cn.label = l.label""",
)(lambda s, d: multihits.normalize_multihit_clusters(P.multihits(s, d), grouping="sample"))


# diversity

_log = f"""WITH {P.ABUNDANCES}, t AS (SELECT event_type, x / sum(x) OVER (PARTITION BY event_type) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM pop)"""


def _index(name: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = diversity.pop_calcs(P.abundances(spark, d), name, "x", ["event_type"])
        return found.select("event_type", F.round("value", 6).alias("value")) if name != "uc50" else found

    return run


query("shannon", f"{_log} SELECT event_type, round(-sum(p * ln(p)), 6) AS value FROM t GROUP BY event_type")(_index("shannon"))
query("entropy", f"{_log} SELECT event_type, round(-sum(p * log2(p)), 6) AS value FROM t GROUP BY event_type")(_index("entropy"))
query("clonality", f"{_log} SELECT event_type, round(1 + sum(p * ln(p)) / ln(max(n)), 6) AS value FROM t GROUP BY event_type")(_index("clonality"))
query(
    "gini",
    f"""WITH {P.ABUNDANCES}, o AS (SELECT event_type, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n,
  sum(x) OVER (PARTITION BY event_type ORDER BY x ROWS UNBOUNDED PRECEDING) / sum(x) OVER (PARTITION BY event_type) AS p, x FROM pop WINDOW w AS (PARTITION BY event_type ORDER BY x)),
c AS (SELECT event_type, i / n AS w, p, lead(i / n) OVER (PARTITION BY event_type ORDER BY i) AS w2, lead(p) OVER (PARTITION BY event_type ORDER BY p) AS p2 FROM o)
SELECT event_type, round(sum(p2 * w - p * w2), 6) AS value FROM c GROUP BY event_type""",
)(_index("gini"))
query(
    "uc50",
    f"""WITH {P.ABUNDANCES}, r AS (SELECT event_type, sum(x) OVER (PARTITION BY event_type ORDER BY x ROWS UNBOUNDED PRECEDING) AS c, sum(x) OVER (PARTITION BY event_type) AS t FROM pop)
SELECT event_type, count(*) AS value FROM r WHERE c >= t / 2 GROUP BY event_type""",
)(_index("uc50"))


# scoring tables

_codes = ", ".join(f"('{c}', '{b}')" for c, b in scoring.BASES.items())


def _scores(many: str, exception: str) -> str:
    return f"""WITH c(code, bases) AS (VALUES {_codes}),
p AS (SELECT a.code AS ref, b.code AS query, len(list_intersect(string_split(a.bases, ''), string_split(b.bases, ''))) AS k, len(a.bases) AS x, len(b.bases) AS y FROM c a, c b)
SELECT ref, query, CAST(CASE WHEN ref = query OR ref = 'N' OR query = 'N' THEN 1 WHEN x = 1 OR y = 1 THEN (CASE WHEN k > 0 THEN 1 ELSE 0 END) {exception} ELSE {many} END AS DOUBLE) AS score FROM p"""


_odd = "WHEN ref = 'V' AND query = 'S' THEN 0.66"
query("banmat", _scores("0", ""))(lambda s, d: scoring.banmat(s))
query("ssanmat", _scores("round(k / greatest(x, y), 2)", _odd))(lambda s, d: scoring.ssanmat(s))
query("asanmat", _scores("round(k / x, 2)", _odd))(lambda s, d: scoring.asanmat(s))


# reads and random sites

_named = """r AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS read_index, 'r:' || CAST(s_suppkey AS VARCHAR) AS id, repeat('ACGT', CAST(s_suppkey AS INT) % 9 + 1) AS seq FROM supplier)"""


def _reads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reads written as FASTQ and read back, and the sample of each."""
    path = f"{shared_folder(spark)}/reads-{uuid.uuid4().hex}"
    names = P.load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("read_index"), F.concat(F.lit("r:"), F.col("s_suppkey").cast("string")).alias("id"), F.repeat(F.lit("ACGT"), F.col("s_suppkey").cast("int") % 9 + 1).alias("seq")
    )
    text = F.concat(F.lit("@"), F.col("id"), F.lit(" x\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    names.orderBy("read_index").select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)
    reads = fastq.read_fastq(spark, path)
    return reads, reads.select(F.col("read_index").alias("index"), F.concat(F.lit("s"), (F.col("read_index") % 3).cast("string")).alias("sampleName"))


query(
    "fastq_demux",
    f"WITH {_named} SELECT 's' || CAST(read_index % 3 AS VARCHAR) AS sampleName, read_index, id, seq, repeat('I', length(seq)) AS qual FROM r",
)(lambda s, d: fastq.demultiplex(*_reads(s, d)))


@query(
    "fastq_sink",
    f"WITH {_named} SELECT 's' || CAST(read_index % 3 AS VARCHAR) || '.R1.fastq.gz' AS file, row_number() OVER (PARTITION BY read_index % 3 ORDER BY read_index) AS read_index, id, seq, repeat('I', length(seq)) AS qual FROM r",
)
def fastq_sink(spark: SparkSession, d: str) -> DataFrame:
    """One compressed file a sample, written and read back."""
    folder = f"{shared_folder(spark)}/demultiplexed-{uuid.uuid4().hex}"
    fastq.write_demultiplexed(*_reads(spark, d), folder, "R1")
    return fastq.read_fastq(spark, f"{folder}/*.fastq.gz").withColumn("file", F.element_at(F.split("file", "/"), -1))


@query(
    "generate_sites",
    "SELECT i AS site, 40 AS reads, true AS near, true AS same_widths, true AS in_range FROM range(50) t(i)",
)
def generate_sites(spark: SparkSession, d: str) -> DataFrame:
    """By site: its reads, whether all start near it, and whether all sites have the same widths, within the range."""
    rows = generate.generate_sites(spark, n_sites=50, n_reads_p_site=40, positions=[1000 * (i + 1) for i in range(50)], seed=3)
    length = F.col("end") - F.col("start") + 1
    by_site = rows.groupBy((F.round(F.col("start") / 1000) - 1).cast("bigint").alias("site")).agg(
        F.count("*").alias("reads"),
        F.max(F.abs(F.col("start") - 1000 * F.round(F.col("start") / 1000))).alias("off"),
        F.sort_array(F.collect_list(length)).alias("widths"),
    )
    all_ = by_site.agg(F.min("widths").alias("lo"), F.max("widths").alias("hi"))
    held = by_site.crossJoin(F.broadcast(all_))  # one row of 40 widths
    return held.select("site", "reads", (F.col("off") <= 8).alias("near"), (F.col("lo") == F.col("hi")).alias("same_widths"), F.forall("widths", lambda w: w.between(30, 100)).alias("in_range"))
