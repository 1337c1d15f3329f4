"""Where rows come from."""

from .landing import LOAD_ID, land, landing_files, quarantine, read_landing, read_landing_split, stamp_load, walk
from .tables import read_seed, read_source
from .windows import NoRowsError, chunk_coverage, date_chunks, load_window, require_rows, window_bounds

__all__ = [name for name in dir() if not name.startswith("_")]
