"""Hand-written ledger lines; a module of its own, as several test folders have a conftest."""

from __future__ import annotations

from pathlib import Path

HEADER = "거래번호,거래일자,계정과목,거래처,금액,적요,담당자,승인자,이상여부,이상유형"
EDGE_LINES = [
    "T1,2024-12-30,acc,A사,1000,memo,p1,a1,0,",
    'T2,2024-12-30,acc,"B,사",,"",p1,a1,,',
    "T3,2024-12-30,acc,C,abc,memo,p1,a1,1,dup",
    "T4,2024-12-30,acc,D,12.5,memo,p1,a1,1",
    "T5,2024-12-31,acc,E,5000000000,memo,p1,a1,5000000000,dup",
    "T6,2024/12/31,acc,F,1,memo,p1,a1,1,dup,extra",
    ",2024-12-30,acc,G,2,memo,p1,a1,0,",
    "T8, 2024-12-30,acc,H,3,memo,p1,a1,0,",
    "T9,,acc,I,4,memo,p1,a1,0,",
    "T10,2024-1-5,acc,J,4,memo,p1,a1,0,",
]
SWAPPED_HEADER = "거래일자,거래번호," + HEADER.split(",", 2)[2]
SWAPPED_LINES = ["2024-12-30,T7,acc,K,9,memo,p1,a1,0,"]


def write_csv(path: Path, *lines: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
