"""Product-offer analytics as Spark jobs: normalise, match, link, rank and maintain offers from many stores."""
