"""The ledger contract: column names, types and the on-disk layout."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Fixed values. The names are the on-disk contract: files bind to them by
# position and the partition directories are spelled with DATE.
TXN_NO = "거래번호"
DATE = "거래일자"
ACCOUNT = "계정과목"
COUNTERPARTY = "거래처"
AMOUNT = "금액"
MEMO = "적요"
PREPARER = "담당자"
APPROVER = "승인자"
LABEL = "이상여부"
LABEL_TYPE = "이상유형"
FLAG = "fds_flag"
# Spells the partition directories on a local file system whose names the JVMs can't hold DATE in.
PLAIN_DATE = "ledger_date"
NULL_FILL = {AMOUNT: 0, LABEL: 0}

RAW_COLUMNS = [
    TXN_NO, DATE, ACCOUNT, COUNTERPARTY, AMOUNT,
    MEMO, PREPARER, APPROVER, LABEL, LABEL_TYPE,
]
REQUIRED = {TXN_NO, DATE}
LONGS = {AMOUNT, LABEL}


def raw_schema(corrupt_column: str | None = None) -> StructType:
    """Ten raw columns in file order, plus a column for unparsable lines if named."""
    schema = StructType()
    for name in RAW_COLUMNS:
        schema.add(name, "long" if name in LONGS else "string", name not in REQUIRED)
    if corrupt_column:
        schema.add(corrupt_column, "string")
    return schema


def fact_schema(flagged: bool, date: str = DATE) -> StructType:
    """Columns of the Parquet fact table; the partition date comes last."""
    schema = StructType()
    for name in RAW_COLUMNS:
        if name != DATE:
            schema.add(name, "long" if name in LONGS else "string")
    if flagged:
        schema.add(FLAG, "integer")
    return schema.add(date, "date")
