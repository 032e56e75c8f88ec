"""Assessment-equity analytics on Spark: ratio studies, tax-base shares, appeal rates and small-area tables."""
