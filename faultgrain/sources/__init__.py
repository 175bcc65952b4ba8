"""Readers and writers: file trees, snapshots, the ledger, text reports."""
