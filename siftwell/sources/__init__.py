"""Readers and writers: documents, logs, reports, contracts, settings, maps; and tables kept between runs."""
