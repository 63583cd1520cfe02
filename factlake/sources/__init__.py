"""Where facts come from and go to: the log, JSON, the frame format, and views of tables."""
