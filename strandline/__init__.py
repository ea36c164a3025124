"""Panel analytics over PySpark DataFrames: calendars, returns, risk, portfolios, streams."""
