"""panelforge: fail-closed panel analysis and corpus preparation as Spark jobs."""
