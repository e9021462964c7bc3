"""tablelake: many years of survey-style tables as Spark DataFrames."""
