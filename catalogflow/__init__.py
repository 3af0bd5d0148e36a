"""catalogflow: DataFrame-first analytics for point-event catalogs on Spark."""
