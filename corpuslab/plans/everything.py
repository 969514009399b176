"""Imports all query modules; the registry then holds every query."""

from . import assembly, chunking, corpus, correction, evaluation, jobs, language, more, ranking, signal, structure  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
