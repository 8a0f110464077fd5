"""The registered queries: every operator run over the given tables, with oracle SQL."""
