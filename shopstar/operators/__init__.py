"""Layer builders (staging, marts, warehouse), fact layout, snapshots, run log, time series."""
