"""Model jobs, quality report, evaluation, and the catalogue of registered queries."""
