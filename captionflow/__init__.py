"""captionflow: DataFrame-native operators for listing, photo and caption corpora."""
