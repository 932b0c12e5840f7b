"""sluice: sensitive-text detection, policy and rewriting as Spark plans."""
