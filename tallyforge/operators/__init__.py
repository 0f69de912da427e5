"""DataFrame-to-DataFrame operators: classification, contract, stores, lookups, reports, views, profiles."""
