"""The registered queries over the star tables."""

from corpusloom.plans import cards, catalogue, evaluation, graphs, ingest, records, retrieval, rewriting, scoring, texts, titles, upkeep
from corpusloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "cards", "catalogue", "evaluation", "graphs", "ingest", "records", "retrieval", "rewriting", "scoring", "texts", "titles", "upkeep"]
