"""Models fitted per series in Arrow-backed grouped functions; the series is split by key, the fit is small NumPy."""
