"""babelyard: a PySpark engine for localisation readiness and content audit."""
