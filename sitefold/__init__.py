"""Genomic integration-site analytics on Spark DataFrames.

The public functions are at the top of the package; each module is loaded when one of its functions is asked for.
"""

from __future__ import annotations

from importlib import import_module

_HOMES = {
    "functions.scoring": ("asanmat", "banmat", "ssanmat"),
    "functions.ids": ("generate_posid",),
    "functions.diversity": ("pop_calcs",),
    "functions.vectors": ("vcollapse", "vintersect", "vzip"),
    "operators.abundance": ("condense_intsites", "determine_abundance"),
    "operators.components": ("cluster_kv",),
    "operators.islands": ("graph_clusters", "serial_cluster"),
    "operators.legacy": ("cluster_sites", "cluster_values", "normalize_intsite_positions", "standardize_by_window"),
    "operators.multihits": ("cluster_multihits", "normalize_multihit_clusters"),
    "operators.scan": ("scan_clusters", "scan_format"),
    "operators.standardize": ("refine_breakpoints", "standardize_sites"),
    "operators.track": ("track_clones",),
    "operators.unique": ("unique_granges",),
    "sources.dbrows": ("db_to_granges", "db_to_sites"),
    "sources.fastq": ("read_fastq", "write_demultiplexed"),
    "sources.generate": ("generate_sites",),
    "streaming.abundance": ("stream_abundance",),
}
_WHERE = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):  # noqa: ANN202
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
