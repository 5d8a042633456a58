"""rankloom: contrastive-direction re-ranking analytics on Spark."""
