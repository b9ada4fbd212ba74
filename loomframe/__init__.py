"""loomframe: film-domain analytics, entity resolution, retrieval and data quality as DataFrame operators."""
