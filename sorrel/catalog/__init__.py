"""Importing the package registers every query."""

from sorrel.catalog.base import QUERIES, SQL  # noqa: F401
from sorrel.catalog import documents, evaluation, files, knowledge, studies, vectors  # noqa: F401
