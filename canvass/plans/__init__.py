"""Jobs made of operators: bundles, cards, batches, scores."""
