"""Window functions; ``operators.windows.with_window`` gives them their window."""

from pyspark.sql import functions as F

row_number, rank, dense_rank, lag, lead = F.row_number, F.rank, F.dense_rank, F.lag, F.lead
ntile, cume_dist, percent_rank = F.ntile, F.cume_dist, F.percent_rank
nth_value, first_value, last_value = F.nth_value, F.first_value, F.last_value
