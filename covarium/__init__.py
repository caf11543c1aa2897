"""covarium: covariance-geometry analytics and corpus operators on PySpark DataFrames."""
