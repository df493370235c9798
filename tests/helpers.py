import os

HEADER = ("artist,song,duration_ms,explicit,year,popularity,danceability,energy,key,loudness,mode,"
          "speechiness,acousticness,instrumentalness,liveness,valence,tempo,genre")


def track_line(artist="Artist A", song="Good Song", duration="200000", year="2001", pop="50",
               tempo="120.0", genre="pop"):
    return (f'{artist},{song},{duration},False,{year},{pop},0.5,0.6,5,-5.0,1,0.05,0.1,0.0,0.1,0.5,'
            f'{tempo},{genre}')


def write_csv(folder, name, lines, header=HEADER):
    os.makedirs(folder, exist_ok=True)
    p = os.path.join(folder, name)
    with open(p, "w") as f:
        f.write("\n".join([header] + list(lines)) + "\n")
    return p
