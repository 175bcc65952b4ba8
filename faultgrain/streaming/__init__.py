"""Structured Streaming forms of intake, triage and attempt counting."""
