"""Factor research, portfolio analytics and training-data preparation as Spark jobs."""
