"""Corpora, evaluation sets, content tables, index bundles and code repositories."""
