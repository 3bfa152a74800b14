"""All queries of the library and the SQL that checks them."""

from . import catalogue

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES
