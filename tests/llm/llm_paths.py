SF01 = "/root/testdata/sf0.01"
