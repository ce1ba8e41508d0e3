"""Where samples and telemetry records come from and go to."""
