"""Writers: relational store, event log, JSON export, Markdown reports."""
