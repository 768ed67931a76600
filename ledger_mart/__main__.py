from ledger_mart.cli import main

main()
