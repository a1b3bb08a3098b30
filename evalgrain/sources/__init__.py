"""Readers and writers of trial logs, tables of hits and pages, and run outputs."""
