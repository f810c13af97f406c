"""dockwatch: station-occupancy analytics on Spark DataFrames."""
