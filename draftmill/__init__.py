"""draftmill: sheet metadata and corpus operators on Spark."""
