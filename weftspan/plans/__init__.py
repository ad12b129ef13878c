"""Helpers that keep plans healthy at scale: size checks, ranking, lineage."""
