"""Training-data operators: quality rules, deduplication, decontamination, language id, HTML
extraction, chat formatting, secret scans and packing. Nothing else in the library imports this
subpackage."""
