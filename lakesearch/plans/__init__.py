"""The registered queries, by family."""

from . import evidence, flows, operations, ranking, specifications, texts, webpages
