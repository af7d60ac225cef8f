"""Cleaning text columns of tables of any size with Spark."""

from rinse.errors import RinseError
from rinse.operators.cells import (
    MATCHED,
    ROW_ID,
    Cell,
    clean,
    clean_alike,
    user_columns,
    with_row_id,
)
from rinse.operators.find_replace import find_replace, replacing
from rinse.operators.mask import mask, masking
from rinse.operators.paging import (
    number_rows,
    number_rows_by,
    number_rows_of_files,
    page_index,
    read_page,
    read_page_of,
)
from rinse.operators.profile import (
    classify_columns,
    infer_date_formats,
    kinds_by_column,
    pattern_counts,
    pattern_examples,
    profile_kinds,
)
from rinse.operators.reformat import first_rule, reformat, writing_dates
from rinse.operators.sampling import sample_values
from rinse.plans.run import Stats, count_result, round_trip, run, run_replace, write_counted
from rinse.plans.specs import Dates, Replace, Rules
from rinse.session import configure
from rinse.sources.catalogue import file_beginnings, file_page, list_files, preview, preview_folder
from rinse.sources.customers import customers
from rinse.sources.tables import read_csv, read_csv_folder, read_folder, read_source
from rinse.sources.workbooks import read_xlsx
from rinse.streaming.streams import clean_stream, csv_stream, windowed_matches

__all__ = [name for name in dir() if not name.startswith("_")]
