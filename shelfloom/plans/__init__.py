"""Jobs built from the operators: generation, optimisation, enrichment, reports."""
