"""DuckDB SQL for the window operators, built phase by phase."""

from __future__ import annotations

from sitefold.plans.samples import SITES

W = "PARTITION BY seqnames, strand ORDER BY pos"
W_ISLAND = "PARTITION BY seqnames, strand, island"


def _islands(source: str, name: str) -> str:
    return f"""{name}_n AS (SELECT *, CASE WHEN coalesce(lag(link) OVER ({W}), 0) = 0 THEN 1 ELSE 0 END AS nw FROM {source}),
{name} AS (SELECT * EXCLUDE (nw), CAST(sum(nw) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM {name}_n)"""


def points(position: str, weight: str) -> str:
    return f"pts AS (SELECT seqnames, strand, {position} AS pos, CAST(sum({weight}) AS BIGINT) AS abund FROM sites GROUP BY ALL)"


def initial(min_gap: int, bias: str) -> str:
    up = "CASE WHEN strand = '-' THEN -1 ELSE 1 END" if bias == "upstream" else "CASE WHEN strand = '-' THEN 1 ELSE -1 END"
    return f"""l1 AS (SELECT *, CASE WHEN lead(pos) OVER ({W}) - pos <= {min_gap} THEN
  CASE WHEN abund > lead(abund) OVER ({W}) THEN 1 WHEN abund < lead(abund) OVER ({W}) THEN -1 ELSE {up} END ELSE 0 END AS link FROM pts)"""


def satellite(source: str, gap: int) -> str:
    """CTEs that end in l<gap>."""
    return f"""{_islands(source, f"i{gap}")},
s{gap} AS (SELECT *, min(abund) OVER ({W_ISLAND}) AS mn, sum(abund) OVER ({W_ISLAND}) AS sm FROM i{gap}),
l{gap} AS (SELECT seqnames, strand, pos, abund, CASE WHEN link = 0 AND lead(pos) OVER ({W}) - pos <= {gap} THEN
  CASE WHEN mn >= lead(mn) OVER ({W}) AND sm > lead(sm) OVER ({W}) THEN 1
       WHEN lead(mn) OVER ({W}) >= mn AND lead(sm) OVER ({W}) > sm THEN -1 ELSE 0 END ELSE link END AS link FROM s{gap})"""


def cuts(source: str, bias: str) -> str:
    """CTEs that end in marked: islands with one source each."""
    left = "strand <> '-'" if bias == "upstream" else "strand = '-'"
    return f"""c1 AS (SELECT *, coalesce(lag(link) OVER ({W}), 0) AS before, pos - lag(pos) OVER ({W}) AS dl, lead(pos) OVER ({W}) - pos AS dr,
  lag(abund) OVER ({W}) AS al, lead(abund) OVER ({W}) AS ar FROM {source}),
c2 AS (SELECT *, CASE WHEN before = 1 AND link = -1 THEN
  CASE WHEN dl <> dr THEN (CASE WHEN dl > dr THEN 'l' ELSE 'r' END) WHEN al <> ar THEN (CASE WHEN al < ar THEN 'l' ELSE 'r' END)
       WHEN {left} THEN 'l' ELSE 'r' END END AS cut FROM c1),
c3 AS (SELECT seqnames, strand, pos, abund, CASE WHEN cut = 'r' OR lead(cut) OVER ({W}) = 'l' THEN 0 ELSE link END AS link FROM c2),
{_islands("c3", "isl")},
marked AS (SELECT *, coalesce(lag(link) OVER ({W}), 0) <> 1 AND link <> -1 AS is_source, coalesce(lag(link) OVER ({W}), 0) <> -1 AND link <> 1 AS is_sink FROM isl)"""


def linked(position: str, weight: str, min_gap: int, sata_gap: int, bias: str) -> str:
    parts = [points(position, weight), initial(min_gap, bias)]
    last = "l1"
    for gap in range(2, sata_gap + 1):
        parts.append(satellite(last, gap))
        last = f"l{gap}"
    return ",\n".join([*parts, cuts(last, bias)])


def grouped(gap: int) -> str:
    """CTEs that end in grp: chains of sources."""
    return f"""g1 AS (SELECT *, last_value(CASE WHEN is_source THEN pos END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM marked),
g2 AS (SELECT *, CASE WHEN is_source AND (prev IS NULL OR pos - prev > {gap}) THEN 1 ELSE 0 END AS nw FROM g1),
g3 AS (SELECT *, sum(nw) OVER ({W} ROWS UNBOUNDED PRECEDING) AS sg FROM g2),
grp AS (SELECT *, CAST(max(CASE WHEN is_source THEN sg END) OVER ({W_ISLAND}) AS BIGINT) AS "group" FROM g3)"""


RESOLVED = """best AS (SELECT *, row_number() OVER (PARTITION BY seqnames, strand, "group" ORDER BY abund DESC, CASE WHEN strand = '-' THEN -pos ELSE pos END) AS rn
  FROM grp WHERE is_source),
called AS (SELECT g.seqnames, g.strand, g.pos, b.pos AS adj FROM grp g JOIN best b ON b.rn = 1 AND g.seqnames = b.seqnames AND g.strand = b.strand AND g."group" = b."group")"""
SOURCES_ONLY = """called AS (SELECT seqnames, strand, pos, max(CASE WHEN is_source THEN pos END) OVER (PARTITION BY seqnames, strand, island) AS adj FROM marked)"""


def standardized(weight: str = "1", min_gap: int = 1, sata_gap: int = 5, details: bool = False) -> str:
    more = ", c.pos AS called_pos, c.adj AS adj_pos" if details else ""
    return f"""WITH {SITES}, {linked("five", weight, min_gap, sata_gap, "upstream")}, {grouped(sata_gap)}, {RESOLVED}
SELECT s.seqnames, CASE WHEN s.strand = '+' THEN c.adj ELSE s."start" END AS "start", CASE WHEN s.strand = '+' THEN s."end" ELSE c.adj END AS "end",
  s.strand, s.sample, s.replicate, s.counts{more}
FROM sites s JOIN called c ON s.seqnames = c.seqnames AND s.strand = c.strand AND s.five = c.pos"""


def refined(weight: str = "1", min_gap: int = 1, sata_gap: int = 3) -> str:
    return f"""WITH {SITES}, {linked("three", weight, min_gap, sata_gap, "downstream")}, {SOURCES_ONLY}
SELECT s.seqnames, CASE WHEN s.strand = '+' THEN s."start" ELSE c.adj END AS "start", CASE WHEN s.strand = '+' THEN c.adj ELSE s."end" END AS "end",
  s.strand, s.sample, s.replicate, s.counts
FROM sites s JOIN called c ON s.seqnames = c.seqnames AND s.strand = c.strand AND s.three = c.pos"""


def chained(gap: int, position: str = "five", source: str = "sites") -> str:
    """CTEs that end in chain: distinct positions with their chain's number over all strands and first position."""
    order = "ORDER BY seqnames, CASE strand WHEN '+' THEN 0 WHEN '-' THEN 1 ELSE 2 END, pos"
    return f"""d AS (SELECT DISTINCT seqnames, strand, {position} AS pos FROM {source}),
d1 AS (SELECT *, CASE WHEN pos - lag(pos) OVER ({W}) <= {gap} THEN 0 ELSE 1 END AS nw FROM d),
d2 AS (SELECT seqnames, strand, pos, CAST(sum(nw) OVER ({order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS number FROM d1),
chain AS (SELECT *, min(pos) OVER (PARTITION BY number) AS island FROM d2)"""


def components(pairs: str, by: str = "") -> str:
    """CTEs that end in label (node, label) for pairs (k, v): least key that can be reached over shared values."""
    keys = f"{by}, " if by else ""
    same = f"AND a.{by} = b.{by} " if by else ""
    return f"""edge AS (SELECT DISTINCT {"a." + by + ", " if by else ""}a.k AS u, b.k AS w FROM {pairs} a JOIN {pairs} b ON a.v = b.v {same}),
reach({keys}u, w) AS (SELECT {keys}u, w FROM edge UNION SELECT {"r." + by + ", " if by else ""}r.u, e.w FROM reach r JOIN edge e ON r.w = e.u {"AND r." + by + " = e." + by if by else ""}),
label AS (SELECT {keys}u AS node, min(w) AS label FROM reach GROUP BY ALL)"""
