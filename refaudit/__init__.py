"""Audits the bibliographies of document corpora on Spark."""
