from .archives import inflate_archives, list_files
from .catalog import (
    accumulate_pages,
    expected_values,
    parse_catalog,
    parse_download_list,
    read_catalog,
    read_code_sheets,
    read_download_list,
    scan_code_sheet,
    scan_codepage_table,
    scan_footers,
    scan_pages,
    scan_parquet,
    scan_schema_descriptors,
    undecodable_values,
)
from .lines import lines_of_rows, pack_blocks, scan_delimited, scan_lines
from .zipped import sample_head, scan_archives

__all__ = [name for name in dir() if not name.startswith("_")]
