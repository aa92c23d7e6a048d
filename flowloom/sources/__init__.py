"""Readers and writers: flow layouts, trace files, machine files, stored tables."""
