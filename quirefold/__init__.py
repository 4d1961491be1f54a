"""Page, region and dialogue analytics as plain PySpark DataFrame functions."""
