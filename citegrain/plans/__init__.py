"""The operators on the star schema and text tables that stand in for a corpus, each with its SQL where SQL can say it."""
