from causalrisk.sources.corpus import read_markdown
from causalrisk.sources.files import canonical_names, low_cardinality_columns, read_csv, split_column_types
from causalrisk.sources.sinks import write_fact, write_report, write_section
from causalrisk.sources.tables import read_table, transactions

__all__ = [
    "canonical_names",
    "low_cardinality_columns",
    "read_csv",
    "read_markdown",
    "read_table",
    "split_column_types",
    "transactions",
    "write_fact",
    "write_report",
    "write_section",
]
