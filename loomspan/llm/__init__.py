"""Training-data operators: search, filters, mixing, tokenisation, media and near-duplicate removal."""
