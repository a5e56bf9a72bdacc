"""All queries over the driver's tables and the SQL that checks them."""

from colloquy.plans import file_queries, relational_queries, text_queries

QUERIES = {**relational_queries.QUERIES, **text_queries.QUERIES, **file_queries.QUERIES}
ORACLES = {**relational_queries.ORACLES, **text_queries.ORACLES, **file_queries.ORACLES}
