"""Imports every module of queries, which registers them."""

from tideline.plans import evaluation, generators, pages, ranking, relational, retrieval, scoring, serving, text  # noqa: F401
