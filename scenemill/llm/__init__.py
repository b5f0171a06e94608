"""Training-data operators: media, archives, classifiers, tokens, leaks, repeats, chat, toxicity, near copies, shards, divergence, periods, n-gram links."""
